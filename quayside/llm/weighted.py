"""Document fingerprints by consistent weighted sampling of word and word-pair counts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.spans import SPACE, U64, chunks, mix64, owners, shingles
from quayside.llm.store import bound_batches

SAMPLES = 64
_ROWS = 1024
_UNIT = 2.0**-64


@lru_cache(maxsize=2)
def _keys(samples: int, seed: int) -> np.ndarray:
    """For each of three draws and each sample, what the terms' hashes are mixed with (a column of keys)."""
    counters = np.arange(3 * samples, dtype=U64) + mix64(np.array([seed], dtype=U64))
    return mix64(counters).reshape(3, samples, 1)


def _hashed(terms: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A 64-bit draw for each sample (row) and term (column); mix64 in place."""
    x = terms ^ keys
    shifted = np.empty_like(x)
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
        np.right_shift(x, U64(shift), out=shifted)
        x ^= shifted
        if odd:
            x *= U64(odd)
    return x


def _exponential(hashes: np.ndarray) -> np.ndarray:
    """Exp(1) draws, ascending with the hashes."""
    return -np.log1p(-np.minimum((hashes.astype(np.float64) + 0.5) * _UNIT, 1 - 2.0**-53))


def terms_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, terms, weights, offsets) of the texts in pieces: how often each word and pair of words occurs.

    Words: ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased. Terms are told by 64-bit hashes.
    """
    for chunk in chunks(column):
        words, at = chunk.words(~SPACE)
        pairs, pairs_at = shingles(words, at, 2)
        both = np.concatenate([words, pairs])
        order = np.argsort(np.concatenate([owners(at), owners(pairs_at)]), kind="stable")
        both, both_at = both[order], at + pairs_at
        for a, b in zip(both_at[:-1].tolist(), both_at[1:].tolist(), strict=True):
            both[a:b].sort()
        new = np.ones(len(both), dtype=bool)
        new[1:] = both[1:] != both[:-1]
        new[both_at[:-1][both_at[:-1] < len(both)]] = True
        begin = np.flatnonzero(new)
        weights = np.diff(np.concatenate([begin, [len(both)]]))
        yield chunk.first, both[begin], weights, np.searchsorted(begin, both_at)


def sample(terms: np.ndarray, weights: np.ndarray, samples: int = SAMPLES, seed: int = 7) -> np.ndarray:
    """The consistent weighted samples of one text: for each, a 16-bit code of the chosen (term, level).

    A sample takes the term with the least a = c exp(-r (t - b + 1)), t = floor(ln w / r + b) being its level, where
    r ~ Gamma(2, 1), c ~ Gamma(2, 1) and b ~ U(0, 1) depend on the term's 64-bit hash, the sample and the seed alone; two
    texts take the same with the probability of their generalised Jaccard similarity, sum of minima over sum of maxima.

    The three come from three Exp(1) draws: r b and r (1 - b) are independent Exp(1), and so are c u and c (1 - u) for
    u = exp(-r (1 - b)), which is uniform. At weight 1 (level 0), a is c u itself: its least hash is the least a.
    """
    keys = _keys(samples, seed)
    best, which, level = np.full(samples, np.inf), np.zeros(samples, dtype=U64), np.zeros(samples, dtype=np.int64)
    columns = np.arange(samples)
    one = weights == 1
    plain, more, ln_w = terms[one], terms[~one], np.log(weights[~one])
    for k in range(0, len(plain), _ROWS):
        f = plain[k : k + _ROWS]
        drawn = _hashed(f, keys[0])
        at = drawn.argmin(axis=1)
        value = np.log(_exponential(drawn[columns, at]))
        better = value < best
        best[better], which[better] = value[better], f[at[better]]
    for k in range(0, len(more), _ROWS):
        f = more[k : k + _ROWS]
        cu, rest, rb = (_exponential(_hashed(f, key)) for key in keys)
        c = cu + rest
        ln_c = np.log(c)
        r = rb + (ln_c - np.log(cu))
        b = rb / r
        t = np.floor(ln_w[k : k + _ROWS] / r + b)
        ln_a = ln_c - r * (t - b + 1)
        at = ln_a.argmin(axis=1)
        value = ln_a[columns, at]
        better = value < best
        best[better], which[better] = value[better], f[at[better]]
        level[better] = t[columns, at][better].astype(np.int64)
    code = mix64(which * U64(0x9E3779B97F4A7C15) + level.astype(U64)) >> U64(48)
    return np.where(np.isinf(best), U64(0), code).astype(np.uint16)


def fingerprints(column: pa.Array, samples: int = SAMPLES) -> np.ndarray:
    """A row of samples for each text; texts without words have zeros."""
    out = np.zeros((len(column), samples), dtype=np.uint16)
    for first, terms, weights, at in terms_of(column):
        for d in range(len(at) - 1):
            if at[d + 1] > at[d]:
                out[first + d] = sample(terms[at[d] : at[d + 1]], weights[at[d] : at[d + 1]], samples)
    return out


def _hex(prints: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in prints]


def fingerprint(docs: DataFrame, *, samples: int = SAMPLES) -> DataFrame:
    """``docs`` (text, any more) with ``fingerprint``: the samples' codes, four hex digits each. Replaces such a column.

    The share of equal codes of two fingerprints estimates the generalised Jaccard similarity of the texts' counts of
    words and word pairs. A null text counts as empty; texts without words have the code 0000 throughout. No shuffle.
    """
    from pyspark.sql import types as T

    from quayside.llm.frames import with_columns_in_arrow

    where = [f.name for f in docs.schema.fields].index("text")
    return with_columns_in_arrow(docs, {"fingerprint": T.StringType()}, lambda batch: {"fingerprint": pa.array(_hex(fingerprints(batch.column(where), samples)))})


def _in_ranges(docs: DataFrame, range_bytes: int) -> tuple[DataFrame, int]:
    """``docs`` (doc_id, text) dealt into ranges of doc_id (column part) of some ``range_bytes``, in order (null first, then
    by text), and the number of ranges.

    The least document of each range also goes to the range before it, as a guard (own = false): so that each
    document's successor is at hand, wherever the ranges are cut. Only the texts move, once.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = size // range_bytes + 1
    cuts = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 20 * parts)).first()[0] or []
    cuts = sorted(set(cuts))
    part = F.coalesce(F.array_size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0), F.lit(0))
    dealt = docs.withColumn("part", part)
    full = dealt.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("least")).orderBy("part").collect()  # one row a range
    numbers = [r.part for r in full]
    before = {n: numbers[k - 1] for k, n in enumerate(numbers)}
    if not before:
        return dealt.select("part", "doc_id", "text", F.lit(True).alias("own")), parts
    heads = spark.createDataFrame([(r.part, r.least[1], before[r.part]) for r in full], "part int, least long, before int")
    marked = dealt.join(F.broadcast(heads), "part")
    places = F.when(F.col("doc_id").eqNullSafe(F.col("least")), F.array(F.struct("part", F.lit(True).alias("own")), F.struct(F.col("before").alias("part"), F.lit(False).alias("own"))))
    places = F.coalesce(places, F.array(F.struct("part", F.lit(True).alias("own"))))
    return marked.select(F.explode(places).alias("p"), "doc_id", "text").select("p.part", "doc_id", "text", "p.own"), parts


def op7_fingerprints(spark, sf_dir: str, range_bytes: int = 12 << 20) -> DataFrame:
    """Every document's fingerprint beside that of its edited text and of the next document.

    The next document is the next in order of doc_id (null first, then by text); the last one's is the first. In a
    range, documents come in order, its guard (the next range's least; the first of all for the last range) at the end.
    A range of some ``range_bytes`` is a partition; rows of one doc_id are in one.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    bound_batches(spark)
    ranged, parts = _in_ranges(docs, range_bytes)
    ranged = ranged.repartitionById(parts, "part").sortWithinPartitions("part", F.col("own").desc(), F.col("doc_id").asc_nulls_first(), "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def finish(rows: list[tuple], following: list[tuple]) -> pa.RecordBatch:
        """rows: (doc_id, text, print); following: the next document's of each."""
        edited = []
        for (_, text, _), (_, other, _) in zip(rows, following, strict=True):
            n = len(text) // 4
            edited.append(text[: len(text) - n] + other[:n])
        prints, after = np.stack([r[2] for r in rows]), np.stack([r[2] for r in following])
        new = fingerprints(pa.array(edited, pa.large_string()))
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in edited]
        columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()), digests, _hex(prints), _hex(new), (prints == new).mean(axis=1), (prints == after).mean(axis=1)]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of = None, None
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string()).fill_null("")
            prints = fingerprints(texts)
            rows, following = [], []
            for part, own, *row in zip(batch.column("part").to_pylist(), batch.column("own").to_pylist(), batch.column("doc_id").to_pylist(), texts.to_pylist(), prints, strict=True):
                if last is not None and part == of:
                    rows.append(last)
                    following.append(row)
                last, of = (row if own else None), part
            if rows:
                yield finish(rows, following)

    return ranged.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
