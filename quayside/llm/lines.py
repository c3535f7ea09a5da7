"""Line dedup: a once-seen and a twice-seen Bloom filter, then an exact count of the suspects alone."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.llm.spans import SPACE, U64, Chunk, chunks, distinct, mix64
from quayside.llm.store import bound_batches, keep

SEGMENT = 1 << 16
PROBES = 4
_BLANK = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


class Bloom:
    """A blocked Bloom filter of 64-bit hashes: all probes of a hash fall into one block of 512 bits."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.blocks = bits >> 9
        self.data = np.zeros(bits >> 3, dtype=np.uint8) if data is None else data

    def _places(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        block = ((h >> U64(32)) * U64(self.blocks) >> U64(32)).astype(np.int64) << 6
        own = mix64(h)
        for k in range(PROBES):
            bit = (own >> U64(9 * k)) & U64(511)
            yield block + (bit >> U64(3)).astype(np.int64), (1 << (bit & U64(7)).astype(np.int64)).astype(np.uint8)

    def add(self, h: np.ndarray) -> None:
        for place, bit in self._places(h):
            np.bitwise_or.at(self.data, place, bit)

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), dtype=bool)
        for place, bit in self._places(h):
            found &= (self.data[place] & bit) != 0
        return found


def key_of(line: bytes) -> bytes:
    """The line without white space at both ends, A-Z lower-cased."""
    return line.strip(_BLANK).lower()


def second_hash(key: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little", signed=True)


def line_spans(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines' keys, and each text's offset among its lines (an empty text has one line)."""
    data, offsets = chunk.data, chunk.offsets
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets, breaks, side="right") - 1
    at = np.arange(len(offsets)) + np.searchsorted(breaks, offsets)
    starts, ends = np.empty(at[-1], dtype=np.int64), np.empty(at[-1], dtype=np.int64)
    place = np.arange(len(breaks)) + owner
    starts[at[:-1]], starts[place + 1] = offsets[:-1], breaks + 1
    ends[at[1:] - 1], ends[place] = offsets[1:], breaks
    solid = np.concatenate([np.flatnonzero(~SPACE[data]), [len(data)]])
    i, j = np.searchsorted(solid, starts), np.searchsorted(solid, ends) - 1
    blank = i > j
    first, last = solid[i], solid[np.maximum(j, 0)] + 1
    return np.where(blank, starts, first), np.where(blank, starts, last), at


def word_counts(chunk: Chunk, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many words (runs of signs other than white space) each span has, cut at its ends."""
    begins = chunk.runs(~SPACE)[0]
    return np.searchsorted(begins, ends) - np.searchsorted(begins, starts)


def line_keys(chunk: Chunk, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, whether it has at least ``min_chars`` code points, start and end of each line's key; the texts' offsets."""
    starts, ends, at = line_spans(chunk)
    points = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])
    return chunk.hashes(starts, ends), points[ends] - points[starts] >= min_chars, starts, ends, at


def _per_text(h: np.ndarray, long_enough: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return distinct(h[long_enough], np.concatenate([[0], np.cumsum(long_enough)])[at])


def suspects_filter(texts: DataFrame, bits: int, min_chars: int) -> np.ndarray:
    """Bits of the twice-seen filter over all texts of the frame's one column.

    Each task fills a pair of filters; pairs merge by segments: what is once-seen on both sides is twice-seen.
    The result has ``bits / 8`` bytes, whatever the input's size.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = Bloom(bits), Bloom(bits)
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                h, long_enough, _, _, at = line_keys(chunk, min_chars)
                u, n = np.unique(_per_text(h, long_enough, at)[0], return_counts=True)
                twice.add(u[(n > 1) | once.has(u)])
                once.add(u)
        for k in range(0, len(once.data), SEGMENT):
            a, b = once.data[k : k + SEGMENT], twice.data[k : k + SEGMENT]
            if a.any():
                yield pa.RecordBatch.from_pydict({"segment": [k // SEGMENT], "once": [zlib.compress(a, 1)], "twice": [zlib.compress(b, 1)]})

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = twice = None
        for batch in batches:
            for a, b in zip(batch.column("once"), batch.column("twice"), strict=True):
                a, b = (np.frombuffer(zlib.decompress(x.as_py()), dtype=np.uint8) for x in (a, b))
                once, twice = (a, b) if once is None else (once | a, twice | b | (once & a))
        if twice is not None and twice.any():
            yield pa.RecordBatch.from_pydict({"segment": [key[0].as_py()], "twice": [twice.tobytes()]})

    filled = texts.mapInArrow(fill, "segment long, once binary, twice binary")
    out = np.zeros(bits >> 3, dtype=np.uint8)
    for row in filled.groupBy("segment").applyInArrow(merge, "segment long, twice binary").collect():
        out[row.segment * SEGMENT : row.segment * SEGMENT + len(row.twice)] = np.frombuffer(row.twice, dtype=np.uint8)
    return out


def drop_repeated_lines(docs: DataFrame, *, min_docs: int = 2, min_chars: int = 1, keep_first: bool = True, filter_bits: int = 1 << 27, broadcast_keys: int = 1_000_000, long_words: int | None = None, long_min_docs: int = 2) -> DataFrame:
    """``docs`` (doc_id, text, any more) without the lines that at least ``min_docs`` documents have.

    Lines of more than ``long_words`` words count as repeated from ``long_min_docs`` documents on.

    Lines are the parts between ``\\n``; their key is the line stripped of white space and lower-cased (A-Z).
    Keys of fewer than ``min_chars`` code points are never dropped. ``keep_first``: the documents of the lowest
    doc_id among a key's holders keep its first line; else none does. Adds n_lines (before) and n_dropped;
    columns of these names are replaced. Every row counts as a document, also repeated rows; a null text is
    one empty line and stays null only if nothing else is known of it (it becomes the empty text); a null
    doc_id comes after all others.

    Plan: one scan fills the two filters, one sends suspects' hashes alone (with map-side counts), one drops.
    The repeated keys are sent to all tasks if they are at most ``broadcast_keys`` (24 bytes each), else they
    are joined to the documents that have them.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    bits = spark.sparkContext.broadcast(suspects_filter(plain.select("text"), filter_bits, min_chars))

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = Bloom(filter_bits, bits.value)
        for batch in batches:
            ids = batch.column(0)
            rest = [batch.column(i) for i in range(2, batch.num_columns)]
            for chunk in chunks(batch.column(1)):
                h, long_enough, starts, ends, at = line_keys(chunk, min_chars)
                places = np.flatnonzero(long_enough & twice.has(h))
                owner = np.searchsorted(at, places, side="right") - 1
                keys = chunk.data.tobytes()
                seconds = [second_hash(keys[s:e].lower()) for s, e in zip(starts[places].tolist(), ends[places].tolist(), strict=True)]
                many = word_counts(chunk, starts[places], ends[places]) > long_words if long_words is not None else np.zeros(len(places), dtype=bool)
                rows = np.unique(np.stack([owner, h[places].view(np.int64), np.array(seconds, dtype=np.int64), many.astype(np.int64)]), axis=1) if len(places) else np.zeros((4, 0), dtype=np.int64)
                take = pa.array(rows[0] + chunk.first)
                yield pa.RecordBatch.from_arrays([ids.take(take), *(x.take(take) for x in rest), pa.array(rows[1]), pa.array(rows[2]), pa.array(rows[3] > 0)], names=["doc_id", *("u1", "u2")[: len(rest)], "h", "h2", "many"])

    counted = plain.mapInArrow(suspect, "doc_id long, h long, h2 long, many boolean").groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max("many").alias("many"))
    least = F.when(F.col("many"), min(min_docs, long_min_docs)).otherwise(min_docs)
    repeated = keep(counted.where(F.col("n") >= least).drop("n", "many"), "repeated-lines")

    added = {"text": T.StringType(), "n_lines": T.LongType(), "n_dropped": T.LongType()}
    names = [f.name for f in docs.schema.fields if f.name not in added]
    schema = T.StructType([f for f in docs.schema.fields if f.name in names] + [T.StructField(k, t) for k, t in added.items()])

    def drop(line_of: callable, ids: pa.Array, column: pa.Array) -> tuple[list, list, list]:
        texts, n_lines, n_dropped = column.cast(pa.large_string()).fill_null("").to_pylist(), [], []
        ids = ids.to_pylist()
        for chunk in chunks(column):
            h, long_enough, starts, ends, at = line_keys(chunk, min_chars)
            n_lines += np.diff(at).tolist()
            gone: dict[int, set[int]] = {}
            seen: set = set()
            places, firsts = line_of(chunk, h.view(np.int64), long_enough, starts, ends, at)
            for p, d, first, key in zip(places.tolist(), (np.searchsorted(at, places, side="right") - 1).tolist(), *firsts, strict=True):
                if keep_first and ids[d + chunk.first] == first and (d, key) not in seen:
                    seen.add((d, key))
                else:
                    gone.setdefault(d, set()).add(p - int(at[d]))
            for d in range(len(chunk)):
                n_dropped.append(len(gone.get(d, ())))
                if d in gone:
                    texts[d + chunk.first] = "\n".join(x for k, x in enumerate(texts[d + chunk.first].split("\n")) if k not in gone[d])
        return texts, n_lines, n_dropped

    def match(chunk: Chunk, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, places: np.ndarray, known: callable) -> tuple:
        """Of the places whose first hash is known, those whose second is known too, and their first holders and keys."""
        data, out, firsts, keys = chunk.data.tobytes(), [], [], []
        for p in places.tolist():
            key = (int(h[p]), second_hash(data[starts[p] : ends[p]].lower()))
            found, first = known(p, key)
            if found:
                out.append(p)
                firsts.append(first)
                keys.append(key)
        return np.array(out, dtype=np.int64), (firsts, keys)

    def batch_of(batch: pa.RecordBatch, texts: list, n_lines: list, n_dropped: list, source: list[str]) -> pa.RecordBatch:
        stay = [batch.column(i) for i, name in enumerate(source) if name in names]
        return pa.RecordBatch.from_arrays([*stay, pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[f.name for f in schema.fields])

    source = [f.name for f in docs.schema.fields]
    if repeated.count() <= broadcast_keys:
        bits.destroy()  # no later step of this way reads it; workers would keep a copy of each run's
        table = repeated.toArrow()
        order = np.argsort(table["h"].to_numpy())
        nobody = table["first"].is_null().to_numpy()[order]
        sent = spark.sparkContext.broadcast((table["h"].to_numpy()[order], table["h2"].to_numpy()[order], table["first"].fill_null(0).to_numpy()[order], nobody))

        def by_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sorted_h, h2, first, nobody = sent.value

            def known(p: int, key: tuple[int, int]) -> tuple[bool, int | None]:
                for k in range(*np.searchsorted(sorted_h, [key[0], key[0] + 1]).tolist()) if key[0] < (1 << 63) - 1 else np.flatnonzero(sorted_h == key[0]).tolist():
                    if h2[k] == key[1]:
                        return True, None if nobody[k] else int(first[k])
                return False, None

            def line_of(chunk, h, long_enough, starts, ends, at):
                i = np.minimum(np.searchsorted(sorted_h, h), max(0, len(sorted_h) - 1))
                places = np.flatnonzero(long_enough & (sorted_h[i] == h)) if len(sorted_h) else np.zeros(0, dtype=np.int64)
                return match(chunk, starts, ends, h, places, known)

            for batch in batches:
                yield batch_of(batch, *drop(line_of, batch.column(source.index("doc_id")), batch.column(source.index("text"))), source)

        return docs.mapInArrow(by_table, schema)

    uid = [F.xxhash64("doc_id", "text").alias("u1"), F.xxhash64("text", "doc_id").alias("u2")]
    held = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *uid).mapInArrow(suspect, "doc_id long, u1 long, u2 long, h long, h2 long, many boolean").drop("doc_id", "many").distinct()
    drops = held.join(repeated, ["h", "h2"]).groupBy("u1", "u2").agg(F.collect_list(F.struct("h", "h2", "first")).alias("known"))
    numbered = docs.toDF(*[f"c{i}" for i in range(len(source))])
    d, t = (F.col(f"c{source.index(x)}") for x in ("doc_id", "text"))
    joined = numbered.withColumns({"u1": F.xxhash64(d, t), "u2": F.xxhash64(t, d)}).join(drops, ["u1", "u2"], "left").drop("u1", "u2")

    def by_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [{(x["h"], x["h2"]): x["first"] for x in row or ()} for row in batch.column(len(source)).to_pylist()]

            def line_of(chunk, h, long_enough, starts, ends, at, known=known):
                owner = np.searchsorted(at, np.arange(len(h)), side="right") - 1
                here = [known[k + chunk.first] for k in owner.tolist()]
                firsts = {a for x in here for a, _ in x}
                places = np.flatnonzero(long_enough & np.isin(h, np.array(sorted(firsts), dtype=np.int64)))
                return match(chunk, starts, ends, h, places, lambda p, key: (key in here[p], here[p].get(key)))

            yield batch_of(batch, *drop(line_of, batch.column(source.index("doc_id")), batch.column(source.index("text"))), source)

    return joined.mapInArrow(by_join, schema)


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_repeated_lines(docs, min_docs=10, min_chars=1, keep_first=False)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT r, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
bad AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT d.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE bad.key IS NOT NULL)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (WHERE bad.key IS NULL), '')) AS kept_sha256
FROM d JOIN k USING (r) LEFT JOIN bad USING (key) GROUP BY d.r, d.doc_id
"""
