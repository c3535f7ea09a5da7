"""Path rules as column expressions: a member name becomes safe relative components, or the code of the first rule it breaks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Device names that no component's stem may have, in any ASCII case (fixed values).
RESERVED = ["CON", "PRN", "AUX", "NUL", "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9", "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9"]


def components(raw: Column) -> Column:
    """Parts between slashes, without the parts that are a dot."""
    return F.filter(F.split(raw, "/", -1), lambda p: p != ".")


def canonical(raw: Column) -> Column:
    return F.array_join(components(raw), "/")


def _component_code(p: Column) -> Column:
    stem = F.upper(F.substring_index(p, ".", 1))
    return (
        F.when(p == "", "path.empty")
        .when(p == ".", F.lit(None))
        .when(p == "..", "path.dotdot")
        .when(F.contains(p, F.lit(":")), "path.ads")
        .when(p.rlike(r'[\x00-\x1F\x7F<>"|?*]'), "path.invalid_char")
        .when(p.rlike(r"[. ]\z"), "path.trailing")
        .when(stem.isin(RESERVED), "path.reserved")
    )


def path_code(raw: Column, max_depth: int = 32) -> Column:
    """The first broken rule's code, or null. Whole-name rules come first, then each component's from the left."""
    parts = F.split(raw, "/", -1)
    first = F.get(F.filter(F.transform(parts, _component_code), lambda c: c.isNotNull()), F.lit(0))
    return (
        F.when(F.contains(raw, F.lit("\0")), "path.nul")
        .when(F.octet_length(raw) != F.char_length(raw), "path.unicode")
        .when(F.contains(raw, F.lit("\\")), "path.invalid_char")
        .when(raw.rlike(r"^(/|[A-Za-z]:)"), "path.absolute")
        .when(first.isNotNull(), first)
        .when(F.size(components(raw)) == 0, "path.empty")
        .when(F.size(components(raw)) > max_depth, "path.depth")
    )


def under(folder: str, path: Column) -> Column:
    """The place of a relative path below ``folder``, and path.escape where it would not be strictly below it: (target, code)."""
    parts = F.split(path, "/", -1)
    out = path.isNull() | F.startswith(path, F.lit("/")) | F.exists(parts, lambda p: p.isin("", ".", ".."))
    return F.struct(F.when(~out, F.concat(F.lit(folder.rstrip("/") + "/"), path)).alias("target"), F.when(out, "path.escape").alias("code"))


def ratio_exceeds(plain: Column, packed: Column, most: Column) -> Column:
    """Whether plain > most * packed, without overflow of longs; nothing packed makes any plain byte too much."""
    return F.when(most.isNull(), F.lit(False)).when(packed == 0, plain > 0).otherwise((plain > 0) & (F.call_function("div", plain - 1, packed) >= most))
