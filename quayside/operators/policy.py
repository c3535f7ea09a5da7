"""The policy of an inspection: its limits, what it reserves, and its digest."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass

from quayside.operators.admission import Caps


@dataclass(frozen=True)
class Policy:
    """Limits that may be changed, and reserved controls (fixed values) that may not: only their defaults are supported."""

    schema: str = "quayside.policy.v1"
    id: str = "quayside:policy/default/v1"
    formats: tuple[str, ...] = ("zip",)
    max_archive_bytes: int = 512 << 20
    max_files: int = 10_000
    max_member_bytes: int = 1 << 30
    max_total_bytes: int = 5 << 30
    max_ratio: int | None = 100
    max_path_depth: int = 32
    max_metadata_bytes: int = 4 << 20
    max_dict_bytes: int = 64 << 20
    symlinks: str = "deny"
    hardlinks: str = "deny"
    overwrite: str = "refuse"
    setuid: str = "strip"
    nested_depth: int = 1
    ambiguity: str = "deny"
    case_fold_collision: str = "deny"
    magic_vs_extension: str = "deny"
    encrypted: str = "deny"
    atomic: bool = False

    def digest(self) -> str:
        """SHA-256 of the policy as compact JSON, in the order of its fields."""
        return hashlib.sha256(json.dumps(dataclasses.asdict(self), separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

    def unsupported(self) -> str | None:
        """What of the policy isn't supported, or None. It is asked before any archive is read."""
        for f in dataclasses.fields(self):
            own = getattr(self, f.name)
            free = f.name in ("id", "atomic", "max_archive_bytes") or f.name in {c.name for c in dataclasses.fields(Caps)}
            if not free and own != f.default:
                return f"{f.name} {own!r}: only {f.default!r} is supported"
        return None

    def caps(self) -> Caps:
        return Caps(**{c.name: getattr(self, c.name) for c in dataclasses.fields(Caps)})
