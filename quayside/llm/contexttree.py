"""LM scoring by context-tree weighting of bytes, each split into eight binary choices."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.spans import SPACE, U64, Chunk, chunks, mix64
from quayside.llm.store import bound_batches, keep

#: Stands before a text's first byte and after its last; no byte of UTF-8.
EDGE = 0xFF
#: The key of the end that every text has as its last token.
END = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Keys that are held at once before they are summed.
_KEYS = 1 << 20
#: Blocks whose keys one group merges, or answers.
_FAN = 64


def _ln_gamma(x, log):
    """ln of Gamma(x), x >= 1/2, by Stirling's series at x + 6; right to ten digits. Of columns or of arrays."""
    y = x + 6
    series = (y - 0.5) * log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - log(x * (x + 1) * (x + 2)) - log((x + 3) * (x + 4) * (x + 5))


def kt(zeros, ones, log=F.log):
    """ln of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return _ln_gamma(zeros + 0.5, log) + _ln_gamma(ones + 0.5, log) - _ln_gamma(zeros + ones + 1.0, log) - math.log(math.pi)


def _grams(chunk: Chunk, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text and its end: ``depth`` bytes of context, the nearest first, then the byte itself, packed
    (so ascending keys of a subtree stand together); the offsets."""
    n = np.diff(chunk.offsets)
    at = chunk.offsets + np.arange(len(n) + 1)
    wide = np.full(len(chunk.data) + len(n) * (depth + 1), EDGE, dtype=np.uint8)
    place = np.arange(len(chunk.data)) + np.repeat(np.arange(len(n)) * (depth + 1) + depth, n)
    wide[place] = _LOWER[chunk.data]
    del place
    begin = chunk.offsets[:-1] + np.arange(len(n)) * (depth + 1)
    take = np.repeat(begin - at[:-1], n + 1) + np.arange(at[-1])
    code = np.zeros(len(take), dtype=np.int64)
    for k in [*range(depth - 1, -1, -1), depth]:
        code <<= 8
        code |= wide[k:][take]
    return code, at


def _tokens(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' words, then the end, all negative (grams are not); the offsets."""
    words, at = chunk.words(~SPACE)
    keys = np.insert(words.view(np.int64), at[1:], END) | np.int64(-1 << 63)
    return keys, at + np.arange(len(at))


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers compressed byte by byte of their places."""
    return zlib.compress(np.ascontiguousarray(numbers, dtype=np.int64).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _packed(keys: np.ndarray) -> bytes:
    """Ascending keys as compressed differences."""
    return _planes(np.diff(keys, prepend=np.int64(0)))


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data))


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and the sums of their counts."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


def _gram_counts(grams: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_summed`` for keys of 56 bits and counts of 0 or 1: sorted by value, as that is far faster than by place."""
    if not len(grams):
        return grams, learned
    both = np.sort(grams << 1 | learned)
    keys = both >> 1
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(both & 1, first)


def _looked_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The values of ``asked``, all among the ascending ``keys``: each distinct one is looked up once, in order."""
    distinct, place = np.unique(asked, return_inverse=True)
    return values[np.searchsorted(keys, distinct)][place]


class _Sums:
    """Counts of keys, given in pieces: pieces are summed as they reach ``_KEYS`` keys, or half of what is summed already."""

    def __init__(self) -> None:
        self.keys, self.n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.more: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.more.append((keys, n))
        self.waiting += len(keys)
        if self.waiting > max(_KEYS, len(self.keys) // 2):
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if self.more:
            pieces = [(self.keys, self.n), *self.more]
            self.more, self.waiting, self.keys, self.n = [], 0, None, None
            keys, n = (np.concatenate(x) for x in zip(*pieces, strict=True))
            del pieces
            self.keys, self.n = _summed(keys, n)
        return self.keys, self.n


def _part(keys: np.ndarray, depth: int, parts: int) -> np.ndarray:
    """Grams are dealt by the nearest bytes of their context, words (in parts of their own) by their hash."""
    near = np.where(keys < 0, keys, keys >> 8 * (depth + 1 - _split(depth)))
    return (mix64(near.view(U64)) % U64(parts)).astype(np.int64) + np.where(keys < 0, parts, 0)


def _split(depth: int) -> int:
    return min(3, depth)


def _observed(docs: DataFrame, depth: int, parts: int) -> DataFrame:
    """(block, part, keys, n) of (block, learn, text), sorted by block: the block's distinct grams and words of that part,
    and how often each is learned from. One block is held at a time."""

    def finished(block: int, sums: _Sums) -> Iterator[pa.RecordBatch]:
        keys, n = sums.total()
        part = _part(keys, depth, parts)
        order = np.argsort(part, kind="stable")
        keys, n, part = keys[order], n[order], part[order]
        at = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
        for i, j in zip(at[:-1], at[1:], strict=True):
            yield pa.RecordBatch.from_pydict({"block": [block], "part": [int(part[i])], "keys": [_packed(keys[i:j])], "n": [_planes(n[i:j])]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, _Sums()
        for batch in batches:
            blocks, learn = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            for block in np.unique(blocks).tolist():
                if block != now:
                    if now is not None:
                        yield from finished(now, sums)
                    now, sums = block, _Sums()
                own = np.flatnonzero(blocks == block)
                for chunk in chunks(batch.column(2).slice(own[0], len(own))):
                    counts = learn[own[chunk.first : chunk.first + len(chunk)]].astype(np.int64)
                    grams, at = _grams(chunk, depth)
                    sums.add(*_gram_counts(grams, np.repeat(counts, np.diff(at))))
                    words, at = _tokens(chunk)
                    sums.add(*_summed(words, np.repeat(counts, np.diff(at))))
        if now is not None:
            yield from finished(now, sums)

    return docs.mapInArrow(run, "block long, part long, keys binary, n binary")


def _merged(asked: DataFrame, blocks: int) -> DataFrame:
    """(part, keys, n) of ``asked``: one row a part, its keys and their counts over all blocks; some 64 rows meet at a time."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in batches:
            for keys, n in zip(batch.column("keys"), batch.column("n"), strict=True):
                sums.add(_unpacked(keys.as_py()), _numbers(n.as_py()))
        keys, n = sums.total()
        yield pa.RecordBatch.from_pydict({"part": [key[0].as_py()], "block": [key[1].as_py()], "keys": [_packed(keys)], "n": [_planes(n)]})

    groups, out = blocks, asked
    while True:
        groups = -(-groups // _FAN)
        out = out.select("part", (F.col("block") % groups).alias("block"), "keys", "n").groupBy("part", "block").applyInArrow(run, "part long, block long, keys binary, n binary")
        if groups == 1:
            return out.drop("block")


class _Subtrees:
    """A part's nodes at the orders from the split to the full depth: each level's parents, counts and weights."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, depth: int):
        self.keys = keys
        ids = np.unique(np.concatenate([np.unique(self._choices(k)) for k in range(8)]))
        self.ids, n0, n1 = ids, np.zeros(len(ids)), np.zeros(len(ids))
        for k in range(8):
            place, one = np.searchsorted(ids, self._choices(k)), (keys >> k) & 1
            n1 += np.bincount(place, weights=n * one, minlength=len(ids))
            n0 += np.bincount(place, weights=n * (1 - one), minlength=len(ids))
        ln_pw, w = kt(n0, n1, np.log), np.ones(len(ids))
        self.levels = []
        for d in range(depth - 1, _split(depth) - 2, -1):
            up_ids, up = np.unique((ids >> 16 << 8) | (ids & 255), return_inverse=True)
            self.levels.append((n0, n1, w, up.astype(np.int32)))
            n0, n1, split = (np.bincount(up, weights=x, minlength=len(up_ids)) for x in (n0, n1, ln_pw))
            ids = up_ids
            if d >= _split(depth):
                stop = kt(n0, n1, np.log)
                ln_pw = np.logaddexp(stop, split) - math.log(2)
                w = np.exp(stop - math.log(2) - ln_pw)
        self.top, self.n0, self.n1, self.split = ids, n0, n1, split

    def _choices(self, k: int) -> np.ndarray:
        """Of each key, the node of the choice of its byte's bit ``k``: the context and the bits before."""
        return (self.keys >> 8 << 8) + (((self.keys & 255) + 256) >> (k + 1))

    def values(self, a: np.ndarray, s: np.ndarray, r: np.ndarray, last: np.ndarray) -> np.ndarray:
        """log10 of each gram's probability, given what is mixed above the split: see ``_above``."""
        for n0, n1, w, up in reversed(self.levels):
            a, s, r, last = a[up], s[up], r[up], last[up]
            seen, one, own = n0 + n1 > 0, (n1 + 0.5) / (n0 + n1 + 1), r * w
            a, s, last = np.where(seen, a + own * one, a), np.where(seen, s + own, s), np.where(seen, one, last)
            r = np.where(seen, r * (1 - w), r)
        p = np.where(s > 1e-200, np.divide(a, s, out=np.zeros_like(a), where=s > 1e-200), last)
        one, zero, out = np.log10(p), np.log10(1 - p), np.zeros(len(self.keys))
        for k in range(8):
            place = np.searchsorted(self.ids, self._choices(k))
            out += np.where((self.keys >> k) & 1, one[place], zero[place])
        return out


def _roots(merged: DataFrame, depth: int) -> DataFrame:
    """(part, id, n0, n1, split) of each part's parents of the split; words give id -1, their number and the distinct ones learned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, keys, n in zip(batch.column("part"), batch.column("keys"), batch.column("n"), strict=True):
                keys, n = _unpacked(keys.as_py()), _numbers(n.as_py())
                if keys[0] < 0:
                    found = [np.array([-1]), np.array([float(n.sum())]), np.array([float((n > 0).sum())]), np.zeros(1)]
                else:
                    tree = _Subtrees(keys, n, depth)
                    found = [tree.top, tree.n0, tree.n1, tree.split]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found[0]), part.as_py(), np.int64)), *map(pa.array, found)], names=["part", "id", "n0", "n1", "split"])

    return merged.mapInArrow(run, "part long, id long, n0 double, n1 double, split double")


def _parent(node: str) -> Column:
    """The same choice in the context without its farthest byte."""
    return F.shiftleft(F.shiftright(node, 16), 8).bitwiseOR(F.col(node).bitwiseAND(F.lit(255)))


def _above(roots: DataFrame, depth: int) -> DataFrame:
    """(id, a, s, r, last) of the nodes over the split.

    a: estimate mixed so far, s: the weight in it, r: the weight left for deeper contexts, last: the deepest estimate.
    Level by level, each a grouped sum up or an equi-join down.
    """
    top, levels = _split(depth) - 1, []
    for d in range(top, -1, -1):
        below = roots if d == top else levels[-1].withColumnRenamed("ln_pw", "split")
        level = below.groupBy((F.col("id") if d == top else _parent("id")).alias("id")).agg(*[F.sum(x).alias(x) for x in ("n0", "n1", "split")])
        level, most = level.withColumn("kt", kt(F.col("n0"), F.col("n1"))), F.greatest("kt", "split")
        level = level.withColumn("ln_pw", most + F.log(F.exp(F.col("kt") - most) + F.exp(F.col("split") - most)) - math.log(2))
        levels.append(keep(level.select("id", "n0", "n1", "ln_pw", F.exp(F.col("kt") - math.log(2) - F.col("ln_pw")).alias("w")), f"level-{d}"))
    one, seen = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1), F.col("n0") + F.col("n1") > 0
    above = levels[-1].select("id", (F.col("w") * one).alias("a"), F.col("w").alias("s"), (1 - F.col("w")).alias("r"), one.alias("last"))
    for d, level in zip(range(1, top + 1), reversed(levels[:-1]), strict=True):
        up = level.withColumn("up", _parent("id")).join(above.withColumnRenamed("id", "up"), "up")
        own = F.col("r") * F.col("w")
        deeper = {"a": F.col("a") + own * one, "s": F.col("s") + own, "r": F.col("r") * (1 - F.col("w")), "last": one}
        above = up.select("id", *[F.when(seen, new).otherwise(F.col(name)).alias(name) for name, new in deeper.items()])
    return above


def _answers(asked: DataFrame, depth: int, blocks: int) -> tuple[DataFrame, int, int]:
    """(block, keys, values) for each row of ``asked``, and the number of words learned from and of distinct ones.

    Each node of a binary choice's tree (a context of d bytes) weighs stopping there, with its KT estimate, against its
    children: Pw = (KT + product of children's Pw) / 2, KT alone at the full depth. A choice's probability mixes the KT
    estimates along its context, by the posterior of stopping at each. Nodes never learned from pass on what is above,
    renormalised. A part holds whole subtrees, from the split down; the orders over it are tables. A word's value is
    its count. Blocks are answered ``_FAN`` at a time, each time with the part's values once more.
    """
    merged = keep(_merged(asked, blocks), "merged")
    roots = keep(_roots(merged, depth), "roots")
    total, distinct = (int(x) for x in roots.where("id < 0").agg(F.coalesce(F.sum("n0"), F.lit(0.0)), F.coalesce(F.sum("n1"), F.lit(0.0))).first())
    trees = roots.where("id >= 0")
    given = trees.select("part", "id").join(_above(trees, depth), "id")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, n = (f(left[name][0].as_py()) for f, name in ((_unpacked, "keys"), (_numbers, "n")))
        values = n.astype(np.float64)
        if keys[0] >= 0:
            tree, ids = _Subtrees(keys, n, depth), right["id"].to_numpy()
            order = np.argsort(ids)
            place = order[np.searchsorted(ids, tree.top, sorter=order)]
            values = tree.values(*(right[x].to_numpy()[place] for x in ("a", "s", "r", "last")))
        return pa.table([left["part"], left["keys"], pa.array([values.tobytes()], pa.binary())], names=["part", "keys", "values"])

    solved = keep(merged.groupBy("part").cogroup(given.groupBy("part")).applyInArrow(solve, "part long, keys binary, values binary"), "solved")
    groups = -(-blocks // _FAN)
    model = solved.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, values = _unpacked(right["keys"][0].as_py()), np.frombuffer(right["values"][0].as_py())
        out = [values[np.searchsorted(keys, _unpacked(k.as_py()))].tobytes() for k in left["keys"]]
        return pa.table([left["block"], left["keys"], pa.array(out, pa.binary())], names=["block", "keys", "values"])

    questions = asked.select("part", (F.col("block") % groups).alias("group"), "block", "keys")
    answers = questions.groupBy("part", "group").cogroup(model.groupBy("part", "group")).applyInArrow(answer, "block long, keys binary, values binary")
    return answers, total, distinct


def gram_scores(grams: DataFrame, depth: int) -> DataFrame:
    """(key, value) of ``grams`` (key, n): log10 of the byte's probability after its context; for large sets see ``score``.

    A key packs ``depth`` bytes of context, the nearest first, and the byte.
    """

    def pack(rows: pa.Table) -> pa.Table:
        keys, n = _summed(rows["key"].to_numpy(), rows["n"].to_numpy())
        return pa.table({"block": [0], "part": [rows["part"][0].as_py()], "keys": [_packed(keys)], "n": [_planes(n)]})

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, values in zip(batch.column("keys"), batch.column("values"), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(_unpacked(keys.as_py())), pa.array(np.frombuffer(values.as_py()))], names=["key", "value"])

    near = F.shiftright("key", 8 * (depth + 1 - _split(depth)))
    asked = grams.select("key", "n", near.alias("part")).groupBy("part").applyInArrow(pack, "block long, part long, keys binary, n binary")
    return _answers(keep(asked, "asked"), depth, 1)[0].mapInArrow(unpack, "key long, value double")


def score(docs: DataFrame, learn: Column, *, depth: int = 4, block_bytes: int = 8_000_000, max_parts: int = 8192) -> DataFrame:
    """(doc_id, learned, n_bytes, n_tokens, n_known, train_tokens, base_score, score) of ``docs`` (doc_id, text, any more).

    score: log10 of the probability of the text's bytes (A-Z lower-cased) and its end; bits per byte are
    -score * log2(10) / n_bytes. The model is learned from the rows where ``learn`` is true (null: true). base_score:
    log10 probability by word counts, each plus one. A null text counts as empty: its end alone. Other columns are
    ignored; repeated rows count each time. ``depth`` is 1 to 6.

    Plan: documents go to blocks of some ``block_bytes`` by a hash of their id and text. A block's distinct grams and
    words are its questions, sent packed to the part that holds the subtrees of their contexts: half as many parts as
    blocks and 7, ``max_parts`` at most, as distinct grams grow far slower than the text. Parts merge the counts of all
    blocks in rounds of ``_FAN``, solve their subtrees once, and answer the blocks' questions ``_FAN`` blocks at a time.
    So a task holds one block, or a part's distinct keys and ``_FAN`` blocks' questions, and never the model.
    """
    if not 1 <= depth <= 6:
        raise ValueError("depth must be 1 to 6")
    bound_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    blocks = size // block_bytes + 1
    parts = min(max_parts, blocks // 2 + 7)
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    rows = docs.select(F.pmod(F.xxhash64(doc_id, text), F.lit(blocks)).alias("block"), F.coalesce(learn, F.lit(True)).alias("learn"), text.alias("text"), doc_id.alias("doc_id"))
    in_blocks = rows.select("block", "learn", "text").repartition(blocks, "block").sortWithinPartitions("block")
    asked = keep(_observed(in_blocks, depth, parts), "asked")
    answers, total, distinct = _answers(asked, depth, blocks)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n = np.array([len(x.as_py()) >> 3 for x in right["values"]])
        keys, values, end = np.empty(n.sum(), dtype=np.int64), np.empty(n.sum()), 0
        for k, v in zip(right["keys"], right["values"], strict=True):
            own = np.frombuffer(v.as_py())
            keys[end : end + len(own)], values[end : end + len(own)] = _unpacked(k.as_py()), own
            end += len(own)
        del right
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        del order
        out: list[list] = [[], [], [], [], []]
        for chunk in chunks(left["text"]):
            (grams, at), (tokens, token_at) = _grams(chunk, depth), _tokens(chunk)
            count = _looked_up(keys, values, tokens)
            base = np.add.reduceat(np.log10((count + 1) / (total + distinct + 1)), token_at[:-1])
            ours = np.add.reduceat(_looked_up(keys, values, grams), at[:-1])
            for column, new in zip(out, (np.diff(chunk.offsets), np.diff(token_at), np.add.reduceat((count > 0).astype(np.int64), token_at[:-1]), base, ours), strict=True):
                column.append(new)
        n_bytes, n_tokens, n_known, base_score, found = (np.concatenate(c) for c in out)
        columns = [left["doc_id"], left["learn"], n_bytes, n_tokens, n_known, np.full(len(n_bytes), total, np.int64), base_score, found]
        return pa.table(columns, names=["doc_id", "learned", "n_bytes", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, learned boolean, n_bytes long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def op5_lm_score(spark, sf_dir: str, depth: int = 5) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return score(docs, ~held, depth=depth).select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
