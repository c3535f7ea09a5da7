"""Token counts by a finite-state transducer compiled from a tokenizer's pieces."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.llm.frames import with_columns_in_arrow

#: The sign that stands for a space in pieces.
SPACE = "▁"
LANE = 64
POINTS = 1 << 20
_EMPTY = -1


class PieceTransducer:
    """A deterministic transducer over code points: each transition tells by how much the number of tokens changes.

    Pairs of symbols merge by the score of their piece, leftmost first among equals, so (1) the part of an encoding
    that ends at a token's end is that part's own encoding, and (2) a row of pieces is an encoding if every two
    neighbours are. The last token of each prefix is therefore the one piece that ends there and gets on with the last
    token before it. A state holds, for each place from which a piece may still grow, its trie node, the last token
    there and the tokens fewer than now. Transitions are compiled when a text first takes them; the table is emptied
    when it has ``most`` of them, so memory is bounded and counts are the same.
    """

    def __init__(self, path: str, most: int = 1 << 21):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.scores = {model.id_to_piece(k): model.get_score(k) for k in ids if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))}
        if not all(x in self.scores or f"<0x{k:02X}>" == x for k, x in ((k, f"<0x{k:02X}>") for k in range(256)) if model.is_byte(model.piece_to_id(x))):
            raise ValueError("the model has no byte pieces")
        if any(SPACE in p.lstrip(SPACE) for p in self.scores):
            raise ValueError("a piece has a space after another sign: texts can't be cut at spaces")
        self.trie: list[dict[str, int]] = [{}]
        self.piece: list[str | None] = [None]
        for p in self.scores:
            node = 0
            for sign in p:
                if sign not in self.trie[node]:
                    self.trie[node][sign] = len(self.trie)
                    self.trie.append({})
                    self.piece.append(None)
                node = self.trie[node][sign]
            self.piece[node] = p
        self.most = most
        self.signs: dict[int, int] = {}
        self.points: list[int] = []
        self.sign_of = np.full(0x110000, -1, dtype=np.int32)
        self._clear()

    def _clear(self) -> None:
        self.alone: dict[str, bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.states: list[tuple] = [((0, "", 0),)]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.size = 0
        self._table(1 << 16)

    def _table(self, slots: int) -> None:
        self.shift = np.uint64(64 - slots.bit_length() + 1)
        self.mask = slots - 1
        self.keys = np.full(slots, _EMPTY, dtype=np.int64)
        self.to = np.zeros(slots, dtype=np.int32)
        self.delta = np.zeros(slots, dtype=np.int32)

    def encode(self, text: str) -> list[str]:
        """The tokenizer's merges, by the book; used on at most two pieces at a time."""
        symbols = list(text)
        while True:
            best = min(((-self.scores[a + b], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in self.scores), default=None)
            if best is None:
                return symbols
            k = best[1]
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]

    def _follows(self, last: str, piece: str) -> bool:
        if piece not in self.alone:
            self.alone[piece] = self.encode(piece) == [piece]
        if not self.alone[piece]:
            return False
        if not last:
            return True
        if (last, piece) not in self.pairs:
            self.pairs[last, piece] = self.encode(last + piece) == [last, piece]
        return self.pairs[last, piece]

    def step(self, state: tuple, sign: str) -> tuple[tuple, int]:
        """The next state and the change of the number of tokens. The empty last token gets on with every piece."""
        if sign not in self.trie[0]:
            return self.states[0], len(sign.encode("utf-8", "surrogatepass"))
        grown, ends = [], []
        for node, last, fewer in state:
            node = self.trie[node].get(sign, 0)
            if node:
                last = "" if sign == SPACE and last and last[-1] != SPACE else last
                grown.append((node, last, fewer))
                if self.piece[node] is not None and self._follows(last, self.piece[node]):
                    ends.append((self.piece[node], fewer + 1))
        ((token, delta),) = ends
        return (*((n, last, fewer - delta) for n, last, fewer in grown if self.trie[n]), (0, token, 0)), delta

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or the empty one where it would be."""
        slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        found = self.keys[slot]
        away = np.flatnonzero((found != keys) & (found != _EMPTY))
        while len(away):
            slot[away] = (slot[away] + 1) & self.mask
            found = self.keys[slot[away]]
            away = away[(found != keys[away]) & (found != _EMPTY)]
        return slot

    def _put(self, keys: np.ndarray, to: np.ndarray, delta: np.ndarray) -> None:
        if 2 * (self.size + len(keys)) > self.mask:
            held = self.keys != _EMPTY
            keys, to, delta = (np.concatenate([a[held], b]) for a, b in ((self.keys, keys), (self.to, to), (self.delta, delta)))
            self._table(1 << (4 * len(keys)).bit_length())
            self.size = 0
        for k, t, d in zip(keys.tolist(), to.tolist(), delta.tolist(), strict=True):
            s = int(self._slots(np.array([k]))[0])
            self.keys[s], self.to[s], self.delta[s] = k, t, d
        self.size += len(keys)

    def _compile(self, keys: np.ndarray) -> None:
        to, delta = [], []
        for key in keys.tolist():
            state, d = self.step(self.states[key >> 21], chr(self.points[key & 0x1FFFFF]))
            if state not in self.number:
                self.number[state] = len(self.states)
                self.states.append(state)
            to.append(self.number[state])
            delta.append(d)
        if len(keys) > 64:
            self._grow(keys, np.array(to), np.array(delta))
        else:
            self._put(keys, np.array(to), np.array(delta))

    def _grow(self, keys: np.ndarray, to: np.ndarray, delta: np.ndarray) -> None:
        """Many keys at once: each round, those whose slots are free and theirs alone go in."""
        if 2 * (self.size + len(keys)) > self.mask:
            held = self.keys != _EMPTY
            keys, to, delta = (np.concatenate([a[held], b]) for a, b in ((self.keys, keys), (self.to, to), (self.delta, delta)))
            self._table(1 << (4 * len(keys)).bit_length())
            self.size = 0
        self.size += len(keys)
        while len(keys):
            slot = self._slots(keys)
            self.keys[slot] = keys
            won = self.keys[slot] == keys
            self.to[slot[won]], self.delta[slot[won]] = to[won], delta[won]
            keys, to, delta = keys[~won], to[~won], delta[~won]

    def _run(self, signs: np.ndarray, begin: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each lane (a stretch of ``signs``), from its state: the state at its end, and its number of tokens."""
        order = np.argsort(-length, kind="stable")
        begin, length, state = begin[order], length[order], state[order].astype(np.int64)
        count = np.zeros(len(order), dtype=np.int64)
        alive = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), side="left")
        for p, n in enumerate(alive.tolist()):
            keys = (state[:n] << 21) | signs[begin[:n] + p]
            slot = self._slots(keys)
            missing = self.keys[slot] == _EMPTY
            if missing.any():
                self._compile(np.unique(keys[missing]))
                slot = self._slots(keys)
            state[:n] = self.to[slot]
            count[:n] += self.delta[slot]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], count[back]

    def _number_signs(self, points: np.ndarray) -> np.ndarray:
        signs = self.sign_of[points]
        if (signs < 0).any():
            for p in np.unique(points[signs < 0]).tolist():
                self.sign_of[p] = len(self.points)
                self.points.append(p)
            signs = self.sign_of[points]
        return signs.astype(np.int64)

    def _maps(self, signs: np.ndarray, cuts: np.ndarray, length: np.ndarray, reset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every lane's map, as rows (lane, entry state, exit state, tokens) in order of lane and entry.

        A lane that starts at a reset is entered in state 0 only. Another's entries are 0, and whatever exits the lane before
        it has on its own entries: rounds add those until the maps are closed. As states forget what is a few code points
        back, that is one round or two; at most it is as many as the states that a repeating text goes through.
        """
        lane, entry = np.arange(len(cuts)), np.zeros(len(cuts), dtype=np.int64)
        leave, count = self._run(signs, cuts, length, entry)
        rows = [lane, entry, leave, count]
        while True:
            follow = lane + 1 < len(cuts)
            follow[follow] = ~reset[lane[follow] + 1]
            fresh = np.setdiff1d((lane[follow] + 1) << 32 | leave[follow], rows[0] << 32 | rows[1])
            if not len(fresh):
                order = np.argsort(rows[0] << 32 | rows[1])
                return tuple(x[order] for x in rows)
            lane, entry = fresh >> 32, fresh & 0xFFFFFFFF
            leave, count = self._run(signs, cuts[lane], length[lane], entry)
            rows = [np.concatenate(x) for x in zip(rows, (lane, entry, leave, count), strict=True)]

    def _scanned(self, maps: tuple[np.ndarray, ...], reset: np.ndarray) -> np.ndarray:
        """The tokens from the last reset to each lane's end: the lanes' maps composed by a segmented parallel prefix scan."""
        lane, entry, leave, count = maps
        first = np.searchsorted(lane, np.arange(len(reset) + 1))
        slot = np.arange(len(lane)) - first[lane]
        to = np.zeros((len(reset), int(slot.max()) + 1), dtype=np.int64)
        tokens = np.zeros_like(to)
        follow = lane + 1 < len(reset)
        follow[follow] = ~reset[lane[follow] + 1]
        keys = lane << 32 | entry
        to[lane[follow], slot[follow]] = np.searchsorted(keys, (lane[follow] + 1) << 32 | leave[follow]) - first[lane[follow] + 1]
        tokens[lane, slot] = count
        done, step = reset.copy(), 1
        while not done.all():
            k = np.flatnonzero(~done)
            middle = to[k - step]
            tokens[k], to[k] = tokens[k - step] + np.take_along_axis(tokens[k], middle, axis=1), np.take_along_axis(to[k], middle, axis=1)
            done[k] = done[k - step]
            step *= 2
        return tokens[:, 0]

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text (with the space that the tokenizer puts before it; an empty text has none).

        Texts are cut into lanes of some LANE code points, at spaces where there are any: before a space every state
        does, so the lane starts anew (a reset). Each lane gives a map from entry states to exit states and tokens; a
        prefix scan composes the maps between two resets.
        """
        if max(self.size, len(self.pairs), len(self.alone)) > self.most:
            self._clear()
        points = np.frombuffer("".join(SPACE + t if t else "" for t in texts).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if not len(points):
            return [0] * len(texts)
        lengths = np.array([len(t) + 1 if t else 0 for t in texts])
        ends = np.cumsum(lengths)
        starts = ends - lengths
        space = points == ord(SPACE)
        free = space.copy()
        free[1:] &= ~space[:-1]
        first = np.unique(starts[lengths > 0])
        free[first] = True
        # cut at the first free place of each stretch of LANE, or at the stretch's begin
        places = np.flatnonzero(free)
        grid = np.arange(0, len(points), LANE)
        k = np.searchsorted(places, grid)
        near = np.where(k < len(places), places[np.minimum(k, len(places) - 1)], len(points) + LANE)
        cuts = np.unique(np.concatenate([first, np.where(near < grid + LANE, near, grid)]))
        length = np.diff(np.concatenate([cuts, [len(points)]]))
        reset = free[cuts]
        tokens = self._scanned(self._maps(self._number_signs(points), cuts, length, reset), reset)
        last = np.concatenate([reset[1:], [True]])
        total = np.concatenate([[0], np.cumsum(np.where(last, tokens, 0))])
        return (total[np.searchsorted(cuts, ends)] - total[np.searchsorted(cuts, starts)]).tolist()


@lru_cache(maxsize=2)
def _transducer(path: str) -> PieceTransducer:
    return PieceTransducer(path)


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """``docs`` (text, any more) with n_tokens: the tokens of the whole text as the sentencepiece BPE model at
    ``model_path`` (a path on every worker) gives them, without begin or end. Replaces such a column.

    A null text counts as empty and has none. The model must split at spaces and fall back on bytes. No shuffle.
    """
    where = [f.name for f in docs.schema.fields].index("text")

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = batch.column(where).cast(pa.large_string()).fill_null("").to_pylist()
        out, some, points = [], [], 0
        for text in texts:
            some.append(text)
            points += len(text)
            if points > POINTS:
                out += _transducer(model_path).count(some)
                some, points = [], 0
        return {"n_tokens": pa.array(out + _transducer(model_path).count(some), pa.int64())}

    return with_columns_in_arrow(docs, {"n_tokens": T.LongType()}, make)


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = count_tokens(docs, str(public_tokenizers.path("piece_bpe_32k.model")))
    return out.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))
