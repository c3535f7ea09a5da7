"""MinHash near-dedup: bands of MinHash samples propose pairs, odd sketches sift them, full sets confirm them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.graph import components
from quayside.llm.spans import SPACE, U64, chunks, distinct, mix64, owners, shingles
from quayside.llm.store import bound_batches, keep

_BLOCK = 512


@dataclass(frozen=True)
class Sketching:
    """How documents are sketched. A pair of similarity s shares a band with probability 1-(1-s**rows)**bands."""

    width: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5
    bits: int = 512
    set_bits: int = 1024
    sift: float = 0.55
    seed: int = 1

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def most_odd(self) -> int:
        """Odd positions up to which a pair stays a candidate: as many as similarity ``sift`` is expected to give.

        Samples differ in 2k(1-s) of the two sets' items; m items thrown at n bits leave n(1-exp(-2m/n))/2 of them odd.
        ``sift`` is some six standard deviations under the least similarity that links.
        """
        m = 2 * self.samples * (1 - self.sift)
        return int(self.bits * (1 - np.exp(-2 * m / self.bits)) / 2)


def samples_of(values: np.ndarray, s: Sketching) -> np.ndarray:
    """The MinHash samples of a set of 64-bit hashes: the least of each of ``samples`` permuted 32-bit hashes."""
    keys = mix64(np.arange(1, 2 * s.samples + 1, dtype=U64) * U64(0x632BE59BD9B4E019) + U64(s.seed))
    flip, times = (keys[: s.samples] >> U64(32)).astype(np.uint32), (keys[s.samples :] >> U64(32)).astype(np.uint32) | np.uint32(1)
    x = (values >> U64(32)).astype(np.uint32)
    least = np.full(s.samples, 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(x), _BLOCK):
        np.minimum(least, ((x[k : k + _BLOCK, None] ^ flip) * times).min(axis=0), out=least)
    return least


def odd_sketches(samples: np.ndarray, bits: int) -> np.ndarray:
    """For each row of samples, the parity bitmap of its (number, sample) items, as 64-bit words."""
    n, k = samples.shape
    place = (mix64(samples.astype(U64) + (np.arange(k, dtype=U64) << U64(32))) % U64(bits)).astype(np.int64)
    odd = np.bincount((place + np.arange(n)[:, None] * bits).ravel(), minlength=n * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, bits), axis=1).view(np.int64)


def _parities(values: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """For each text, the parity bitmap of its whole set."""
    n = len(at) - 1
    odd = np.bincount(owners(at) * bits + (values & U64(bits - 1)).astype(np.int64), minlength=n * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, bits), axis=1).view(np.int64)


def _lists(values: np.ndarray, at: np.ndarray | int) -> pa.ListArray:
    if isinstance(at, int):
        at = np.arange(0, values.size + 1, at)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.ascontiguousarray(values).ravel().view(np.int64)))


def _digests(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each text's set, as two columns."""
    sums = [np.concatenate([np.zeros(1, U64), np.cumsum(mix64(values ^ U64(c)))]) for c in (0x1F83D9AB, 0x5BE0CD19)]
    lo, hi = ((x[at[1:]] - x[at[:-1]]).view(np.int64) for x in sums)
    return lo, hi


def sketched(docs: DataFrame, s: Sketching) -> DataFrame:
    """(doc_id, text_hash, n, lo, hi, bands, sketch) of (doc_id, text, text_hash): set size, 128-bit digest of the set, band
    keys, and the odd sketch of its MinHash samples followed by that of the set itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                v, at = distinct(*shingles(*chunk.words(~SPACE), s.width))
                n = np.diff(at)
                least = np.stack([samples_of(v[a:b], s) for a, b in zip(at[:-1], at[1:], strict=True)])
                parts = least.reshape(len(n), s.bands, s.rows).astype(U64)
                key = np.broadcast_to(np.arange(1, s.bands + 1, dtype=U64) << U64(40), (len(n), s.bands)).copy()
                for r in range(s.rows):
                    key = mix64(key * U64(0x9E3779B97F4A7C15) + parts[:, :, r])
                own = [batch.column(k).slice(chunk.first, len(n)) for k in (0, 2)]
                both = np.concatenate([odd_sketches(least, s.bits), _parities(v, at, s.set_bits)], axis=1)
                columns = [*own, pa.array(n, pa.int64()), *map(pa.array, _digests(v, at)), _lists(key, s.bands), _lists(both, (s.bits + s.set_bits) // 64)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n", "lo", "hi", "bands", "sketch"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, n long, lo long, hi long, bands array<long>, sketch array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, lo, items) of (doc_id, text): half of its set's digest, and the ascending hashes of all its distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                v, at = distinct(*shingles(*chunk.words(~SPACE), width))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(chunk)), pa.array(_digests(v, at)[0]), _lists(v, at)], names=["doc_id", "lo", "items"])

    return docs.mapInArrow(run, "doc_id long, lo long, items array<long>")


def _odd(x: str, y: str, first: int, end: int) -> Column:
    """Population count of the XOR of two sketches' words from ``first`` to ``end``."""
    counts = [F.bit_count(F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k)))) for k in range(first, end)]
    return sum(counts[1:], counts[0])


def _likely(s: Sketching, x: str, y: str, nx: str, ny: str) -> Column:
    """Whether the sketches let the pair be similar enough.

    Sets that link differ in d <= (nx + ny)(1 - t)/(1 + t) items. Their own bitmaps then differ in d bits at most, which
    no linked pair breaks; for large sets, whose items fall on each other, the expected number and six standard
    deviations are less.
    """
    half = s.set_bits / 2
    d = (F.col(nx) + F.col(ny)) * ((100 - s.percent) / (100 + s.percent))
    most = F.least(d, half * (1 - F.exp(-d / half)) + 3 * s.set_bits**0.5) + 1e-6
    first, end = s.bits // 64, (s.bits + s.set_bits) // 64
    return (_odd(x, y, first, end) <= most) & (_odd(x, y, 0, first) <= s.most_odd)


#: Members of a band that meet in one group of a comparison.
_MEMBERS = 1024
_PAIR = ("a", "b", "da", "la", "db", "lb")


def _classed(docs: DataFrame, s: Sketching, broadcast_ids: int) -> DataFrame:
    """(doc_id, text_hash, n, class), one row for each of ``docs``; class is the least doc_id of the texts linked with the row's.

    Plan: equal sets become one class first, so copies cost one row. In each band, the members are compared with
    the band's least class (a star). Where a band is then left with several components, the members outside its largest
    component are compared with all others of it, in groups of some ``_MEMBERS`` (so no band is in one task), sifted
    inside the join by their odd sketches: only likely pairs come out. Full sets confirm each pair.
    """
    bound_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    plain = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    all_rows = keep(sketched(plain.withColumn("text_hash", F.xxhash64("text")), s), "sketched")
    named = all_rows.where("n > 0 AND doc_id IS NOT NULL")
    # a class is told by a number of its own: rows of one doc_id may have several texts
    classes = named.groupBy("lo", "hi").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = keep(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    sketch = classes.select("id", "sketch", "n", "least", "lo")

    in_bands = classes.select(F.explode("bands").alias("band"), "id")
    # kept, so that the join below has plain exchanges on both sides and a very common band can be split
    tops = keep(in_bands.groupBy("band").agg(F.min("id").alias("top"), F.count(F.lit(1)).alias("members")).where("members > 1"), "tops")
    banded = keep(in_bands.join(tops, "band"), "banded")
    stars = banded.where("id != top").select(F.col("top").alias("a"), F.col("id").alias("b")).distinct()
    stars = stars.join(sketch.toDF("a", "x", "nx", "da", "la"), "a").join(sketch.toDF("b", "y", "ny", "db", "lb"), "b").where(_likely(s, "x", "y", "nx", "ny"))
    links = keep(_confirmed(plain, keep(stars.select(*_PAIR), "stars"), s, broadcast_ids), "links")

    found = components(links)
    rest = banded.where("members > 2").join(found.withColumnRenamed("node", "id"), "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    sizes = rest.groupBy("band", "component").agg(F.count(F.lit(1)).alias("size"))
    mixed = sizes.groupBy("band").agg(F.max_by("component", F.struct("size", "component")).alias("large"), F.sum("size").alias("members"), F.count(F.lit(1)).alias("several")).where("several > 1")
    mixed = keep(mixed, "mixed")
    groups = F.ceil(F.col("members") / _MEMBERS)
    rest = rest.join(mixed.select("band", "large", groups.alias("groups")), "band").join(sketch, "id")
    rest = keep(rest.select("band", "id", "component", (F.col("component") == F.col("large")).alias("large"), "groups", "sketch", "n", "least", "lo"), "rest")
    x = rest.where("NOT large").select("band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("g"), F.col("id").alias("a"), F.col("component").alias("ca"), F.col("sketch").alias("x"), F.col("n").alias("nx"), F.col("least").alias("da"), F.col("lo").alias("la"))
    y = rest.select("band", F.pmod(F.xxhash64("id"), F.col("groups")).alias("g"), F.col("id").alias("b"), F.col("component").alias("cb"), "large", F.col("sketch").alias("y"), F.col("n").alias("ny"), F.col("least").alias("db"), F.col("lo").alias("lb"))
    pairs = x.join(y, (x["band"] == y["band"]) & (x["g"] == y["g"]) & (y["large"] | (x["ca"] < y["cb"])) & _likely(s, "x", "y", "nx", "ny")).select(*_PAIR).distinct()
    more = keep(_confirmed(plain, keep(pairs, "pairs"), s, broadcast_ids), "more-links")
    if not more.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))

    least = found.withColumnRenamed("node", "id").join(classes.select("id", "least"), "id").groupBy("component").agg(F.min("least").alias("class"))
    of_class = classes.select("lo", "hi", "id", "least").join(found.withColumnRenamed("node", "id"), "id", "left").join(least, "component", "left").select("lo", "hi", F.coalesce("class", "least").alias("class"))
    return keep(all_rows.select("doc_id", "text_hash", "n", "lo", "hi").join(of_class, ["lo", "hi"], "left").select("doc_id", "text_hash", "n", "class"), "classed")


def near_duplicates(docs: DataFrame, s: Sketching | None = None, *, broadcast_ids: int = 2_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text, any more).

    Texts are sets of ``width``-word shingles (words: ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; fewer words are one
    shingle). Sets with 100 |A n B| >= percent |A u B| are linked, and so are all texts of one doc_id; component_id is
    the least doc_id reachable and kept marks it. Texts without words are linked with nothing: component_id is the row's
    own doc_id. A row without doc_id can't be named by a link: component_id is null and it is kept. Any other column is
    ignored. Plan: see ``_classed``.
    """
    found = _classed(docs, s or Sketching(), broadcast_ids)
    linked = found.where("n > 0 AND doc_id IS NOT NULL")
    several = keep(linked.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("z")).where("a != z").select("doc_id", "a"), "several-texts")
    if not several.isEmpty():
        merged = components(linked.join(several, "doc_id").select("a", F.col("class").alias("b")))
        found = found.join(merged.withColumnRenamed("node", "class"), "class", "left").withColumn("class", F.coalesce("component", "class"))
    component = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("class"))).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _confirmed(plain: DataFrame, pairs: DataFrame, s: Sketching, broadcast_ids: int) -> DataFrame:
    """(a, b) of the pairs of classes (a, b, and of each the least doc_id d and half the digest l) whose full sets are similar enough."""
    ids = keep(pairs.select(F.col("da").alias("doc_id")).union(pairs.select("db")).distinct(), "ids")
    wanted = F.broadcast(ids) if ids.count() <= broadcast_ids else ids
    sets = keep(full_sets(plain.join(wanted, "doc_id", "left_semi"), s.width).dropDuplicates(["doc_id", "lo"]), "sets")
    both = pairs.join(sets.toDF("da", "la", "x"), ["da", "la"]).join(sets.toDF("db", "lb", "y"), ["db", "lb"])
    common = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", common.alias("i"), (F.size("x") + F.size("y") - common).alias("u")).where(100 * F.col("i") >= s.percent * F.col("u")).select("a", "b")


def drop_near_duplicates(docs: DataFrame, s: Sketching | None = None, *, broadcast_ids: int = 2_000_000) -> DataFrame:
    """``docs`` with the rows of one doc_id of each group of linked texts: the least; equal rows of that id all stay.

    Groups are of texts, so where a doc_id has several texts, each stays or goes with its own group and none is lost.
    Rows without words or without doc_id stay. Columns stay as they are.
    """
    found = _classed(docs, s or Sketching(), broadcast_ids)
    gone = found.where("n > 0 AND doc_id != class").select("doc_id", "text_hash").distinct()
    same = (gone["doc_id"] == docs["doc_id"].cast("long")) & (gone["text_hash"] == F.xxhash64(docs["text"].cast("string")))
    return docs.join(gone, same, "left_anti")


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, Sketching(width=4))


#: All pairs that share a shingle, by joins: for small tables only.
SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, doc_id, hash(array_to_string(words[i : i + 3], ' ')) AS g FROM (SELECT *, unnest(range(1, greatest(1, len(words) - 3) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
-- equal sets are compared once
c AS MATERIALIZED (SELECT r, doc_id, min(doc_id) OVER (PARTITION BY n, d) AS least FROM (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n, md5(string_agg(g::VARCHAR, ',' ORDER BY g)) AS d FROM s GROUP BY r)),
t AS MATERIALIZED (SELECT c.doc_id, s.g, n.n FROM c JOIN s USING (r) JOIN n USING (r) WHERE c.doc_id = c.least),
l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(x, y) AS (SELECT a, b FROM e UNION SELECT reach.x, e.b FROM reach JOIN e ON reach.y = e.a),
m AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, CASE WHEN n.n IS NULL THEN w.doc_id ELSE least(c.least, coalesce(m.y, c.least)) END AS component_id,
       w.doc_id = CASE WHEN n.n IS NULL THEN w.doc_id ELSE least(c.least, coalesce(m.y, c.least)) END AS kept
FROM w LEFT JOIN n USING (r) LEFT JOIN c USING (r) LEFT JOIN m ON m.x = c.least
"""
