"""Benchmark decontamination: a generalised suffix automaton of the items, along which the documents stream."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.llm.spans import ALNUM, Chunk, chunks
from quayside.llm.store import bound_batches, keep


class SuffixAutomaton:
    """Accepts every run of words of every item; a state is a class of runs that end at the same places."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        self.items: list[set[int]] = [set()]
        self.whole: list[set[int]] = [set()]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.items.append(set())
        self.whole.append(set())
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state for the run of length ``length[p] + 1`` that ends as ``q`` does."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def add(self, words: list[int]) -> int:
        last = 0
        for word in words:
            last = self._extend(last, word)
        return last


@dataclass
class Windows:
    """The automaton, compiled for streaming: what a match of a given state and length tells."""

    vocabulary: np.ndarray
    shortest: int
    size: int
    automaton: SuffixAutomaton
    long_items: list[frozenset[int]]
    short_items: list[tuple[tuple[int, frozenset[int]], ...]]

    @classmethod
    def of(cls, items: list[list[int]], size: int) -> Windows:
        """``items``: 64-bit hashes of each item's words. Items of fewer than ``size`` words are one window."""
        vocabulary = np.unique(np.array([w for x in items for w in x], dtype=np.uint64))
        number = {int(w): k for k, w in enumerate(vocabulary)}
        a = SuffixAutomaton()
        coded = [[number[w] for w in x] for x in items]
        for words in coded:
            a.add(words)
        for k, words in enumerate(coded):
            state = 0
            for word in words:
                state = a.next[state][word]
                at = state
                while at > 0 and k not in a.items[at]:
                    a.items[at].add(k)
                    at = a.link[at]
            if 0 < len(words) < size:
                a.whole[state].add(k)
        long_items: list[frozenset[int]] = [frozenset()] * len(a.next)
        short_items: list[tuple] = [()] * len(a.next)
        for state in sorted(range(1, len(a.next)), key=a.length.__getitem__):
            above = a.link[state]
            # with `size` words or more, the last `size` of them stand in the items of the shortest state that is so long
            long_items[state] = long_items[above] or (frozenset(a.items[state]) if a.length[state] >= size else frozenset())
            own = ((a.length[state], frozenset(a.whole[state])),) if a.whole[state] else ()
            short_items[state] = short_items[above] + own
        shortest = min([size, *(len(x) for x in items if x)])
        a.items, a.whole = [], []  # what streaming needs of them is compiled
        return cls(vocabulary, shortest, size, a, long_items, short_items)

    def codes(self, words: np.ndarray) -> np.ndarray:
        """Numbers of the words in the items' vocabulary, -1 for others."""
        if not len(self.vocabulary):
            return np.full(len(words), -1)
        place = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[place] == words, place, -1)

    def hits(self, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Which words lie in an occurrence of a window, and the items of each text that occur there.

        Only runs of known words that are at least as long as the shortest window can hold one, so others are passed by.
        """
        hit = np.zeros(len(codes) + 1, dtype=np.int64)
        found: dict[int, set[int]] = {}
        known = np.concatenate([[False], codes >= 0, [False]])
        cut = np.zeros(len(codes) + 1, dtype=bool)
        cut[at] = True
        begins = np.flatnonzero(known[1:] & (~known[:-1] | cut))[: len(codes)]
        ends = np.flatnonzero(known[:-1] & (~known[1:] | cut))
        step, link, length, size = self.automaton.next, self.automaton.link, self.automaton.length, self.size
        for begin, end in zip(begins.tolist(), ends.tolist(), strict=True):
            if end - begin < self.shortest:
                continue
            state = matched = 0
            text = None
            for i, word in enumerate(codes[begin:end].tolist(), begin + 1):
                while word not in step[state] and state:
                    state = link[state]
                    matched = length[state]
                state = step[state].get(word, 0)
                matched = matched + 1 if state else 0
                seen: set[int] = set()
                if matched >= size:
                    hit[i - matched] += 1
                    hit[i] -= 1
                    seen |= self.long_items[state]
                for n, items in self.short_items[state]:
                    if n <= matched:
                        hit[i - n] += 1
                        hit[i] -= 1
                        seen |= items
                if seen:
                    text = int(np.searchsorted(at, begin, side="right")) - 1 if text is None else text
                    found.setdefault(text, set()).update(seen)
        return np.cumsum(hit[:-1]) > 0, found


def _item_words(text: str | None) -> list[int]:
    words: list[int] = []
    for chunk in chunks(pa.array([text], pa.string())):
        words += chunk.words(ALNUM)[0].tolist()
    return words


def compile_items(items: DataFrame, size: int) -> tuple[Windows, list[str | None]]:
    """The automaton of all ``items`` (item_id string, text string) and their ids; they are collected, so their bytes must be bounded."""
    rows = items.collect()
    return Windows.of([_item_words(r.text) for r in rows], size), [r.item_id for r in rows]


def _scanned(windows: Windows, column: pa.Array) -> Iterator[tuple[Chunk, np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, set[int]]]]:
    for chunk in chunks(column):
        starts, ends, at = chunk.runs(ALNUM)
        hit, found = windows.hits(windows.codes(chunk.hashes(starts, ends)), at)
        yield chunk, starts, ends, at, hit, found


def _ranges(starts: np.ndarray, ends: np.ndarray, hit: np.ndarray) -> list[tuple[int, int]]:
    """Of the words that are hit, the spans from the first to the last of each row."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return list(zip(starts[np.flatnonzero(edge == 1)].tolist(), ends[np.flatnonzero(edge == -1) - 1].tolist(), strict=True))


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without spans of its bytes; each leaves one line break."""
    data = text.encode()
    keep = [0, *(x for s in spans for x in s), len(data)]
    return b"\n".join(data[keep[k] : keep[k + 1]] for k in range(0, len(keep), 2)).decode()


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_ADDED = {"text": T.StringType(), "n_words": T.LongType(), "n_hit": T.LongType(), "items": T.ArrayType(T.StringType()), "spans": T.ArrayType(_SPAN), "over_coverage": T.BooleanType()}


def _columns(texts: list, n_words: list, n_hit: list, items: list, spans: list, max_coverage: float) -> list[pa.Array]:
    """The added columns; spans: (start, end) of bytes."""
    over = np.array(n_hit) > max_coverage * np.array(n_words)
    ranges = [[{"start": s, "end": e} for s, e in own] for own in spans]
    columns = [pa.array(texts, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string()))]
    return [*columns, pa.array(ranges, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(over)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, max_coverage: float = 0.5, max_item_bytes: int = 1 << 20) -> DataFrame:
    """``docs`` (doc_id, text, any more) without the spans that benchmark items (item_id, text) also have.

    Words are ``[0-9A-Za-z]`` and non-ASCII runs, A-Z lower-cased. A span is removed if it has ``window`` words in a
    row that stand in a row in an item, or a whole item of fewer words. ``text`` becomes the text without its spans
    (each leaves one line break); other columns stay. Adds n_words, n_hit (words in removed spans), items (ids as
    strings, sorted; null ids left out), spans (array of code-point-free byte ranges start, end in the UTF-8 text) and
    over_coverage: n_hit > max_coverage * n_words. Columns of these names are replaced. A null text stays null and has
    no words. Removal is repeated while what it brings together makes a new span.

    Plan: the automaton goes to all tasks; one scan, no shuffle. Items of more than ``max_item_bytes`` are dealt into parts
    of some so many bytes by a hash; each part's automaton is sent and streamed after the other, and what they hit is
    united by row: see ``_in_parts``.
    """
    bound_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if total > max_item_bytes:
        return _in_parts(docs, keep(items, "items"), window, max_coverage, -(-total // max_item_bytes))
    sent = docs.sparkSession.sparkContext.broadcast(compile_items(items, window))
    source = [f.name for f in docs.schema.fields]
    stay = [i for i, x in enumerate(source) if x not in _ADDED]
    schema = T.StructType([docs.schema.fields[i] for i in stay] + [T.StructField(k, t) for k, t in _ADDED.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, ids = sent.value
        for batch in batches:
            column = batch.column(source.index("text")).cast(pa.string())
            texts, n_words, n_hit, items, spans = column.to_pylist(), [], [], [], []
            for chunk, starts, ends, at, hit, found in _scanned(windows, column):
                sums = np.concatenate([[0], np.cumsum(hit)])[at]
                n_words += np.diff(at).tolist()
                n_hit += np.diff(sums).tolist()
                for d in range(len(chunk)):
                    items.append(sorted(x for x in {ids[k] for k in found.get(d, ())} if x is not None))
                    a, b, base = at[d], at[d + 1], chunk.offsets[d]
                    own = _ranges(starts[a:b] - base, ends[a:b] - base, hit[a:b]) if d in found else []
                    spans.append(own)
                    left = texts[d + chunk.first]
                    while own:
                        left = _without(left, own)
                        own = [r for _, s, e, _, h, f in _scanned(windows, pa.array([left])) if f for r in _ranges(s, e, h)]
                    texts[d + chunk.first] = left
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in stay), *_columns(texts, n_words, n_hit, items, spans, max_coverage)], names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def _part_hits(rows: DataFrame, windows: Windows, ids: list[str | None]) -> DataFrame:
    """(row, spans, items) of the ``rows`` (row, text) that an automaton hits."""
    sent = rows.sparkSession.sparkContext.broadcast((windows, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, ids = sent.value
        for batch in batches:
            for chunk, starts, ends, at, hit, found in _scanned(windows, batch.column(1)):
                out = []
                for d, numbers in found.items():
                    a, b, base = at[d], at[d + 1], chunk.offsets[d]
                    own = _ranges(starts[a:b] - base, ends[a:b] - base, hit[a:b])
                    out.append({"row": batch.column(0)[d + chunk.first].as_py(), "spans": [{"start": s, "end": e} for s, e in own], "items": [x for x in {ids[k] for k in numbers} if x is not None]})
                if out:
                    kinds = pa.schema([("row", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
                    yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return rows.select("row", "text").mapInArrow(run, "row long, spans array<struct<start:long,end:long>>, items array<string>")


def _merged(text: str, spans: list[dict]) -> tuple[int, int, list[tuple[int, int]]]:
    """Words of the text, those within the spans, and the spans of rows of them."""
    chunk = next(chunks(pa.array([text], pa.large_string())))
    starts, ends, _ = chunk.runs(ALNUM)
    inside = np.zeros(len(starts) + 1, dtype=np.int64)
    for s in spans:
        inside[np.searchsorted(starts, s["start"])] += 1
        inside[np.searchsorted(ends, s["end"], side="right")] -= 1
    hit = np.cumsum(inside[:-1]) > 0
    return len(starts), int(hit.sum()), _ranges(starts, ends, hit)


def _in_parts(docs: DataFrame, items: DataFrame, window: int, max_coverage: float, parts: int) -> DataFrame:
    """``decontaminate`` for items of any size: as many scans as parts, then the rows that were hit once more, while any are.

    Rows get numbers of their own; only the spans and item ids of hit rows are grouped and joined, and the texts of hit
    rows written anew.
    """
    base = keep(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    now = base.select(F.col("_row").alias("row"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    first, cut, number = None, [], 0
    while True:
        found = []
        for k in range(parts):
            part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
            found.append(keep(_part_hits(now, *compile_items(part, window)), f"hits-{number}-{k}"))
        hits = functools.reduce(DataFrame.union, found).groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        hits = keep(hits, f"hits-{number}")
        if first is None:
            first = hits
        if hits.isEmpty():
            break

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [_without(t, _merged(t, s)[2]) for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

        now = keep(now.join(hits.select("row", "spans"), "row").mapInArrow(run, "row long, text string"), f"cut-{number}")
        cut.append(now.withColumn("number", F.lit(number)))
        number += 1
    source = [f.name for f in docs.schema.fields]
    stay = [x for x in source if x not in _ADDED]
    plain = base.select(F.col("_row").alias("_r"), F.col("text").cast("string").alias("_t"), F.struct(*[F.col(f"`{x}`") for x in stay]).alias("_rest"))
    rows = plain.join(first.select(F.col("row").alias("_r"), F.col("spans").alias("_spans"), F.col("items").alias("_items")), "_r", "left")
    if cut:
        last = functools.reduce(DataFrame.union, cut).groupBy("row").agg(F.max_by("text", "number").alias("_left"))
        rows = rows.join(last.withColumnRenamed("row", "_r"), "_r", "left")
    else:
        rows = rows.withColumn("_left", F.lit(None).cast("string"))
    schema = T.StructType([docs.schema[x] for x in stay] + [T.StructField(k, t) for k, t in _ADDED.items()])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(t, left if spans else t, *_merged(t or "", spans or []), items or []) for t, left, spans, items in zip(*(batch.column(x).to_pylist() for x in ("_t", "_left", "_spans", "_items")), strict=True)]
            made = _columns([r[1] for r in own], [r[2] for r in own], [r[3] for r in own], [r[5] for r in own], [r[4] for r in own], max_coverage)
            rest = batch.column("_rest")
            yield pa.RecordBatch.from_arrays([*(rest.field(k) for k in range(len(stay))), *made], names=[f.name for f in schema.fields])

    return rows.select("_t", "_left", "_spans", "_items", "_rest").mapInArrow(finish, schema)


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    joined = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), joined, (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
v AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(words[i : i + n - 1], ' ') AS g FROM (SELECT *, least(10, len(words)) AS n, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i FROM b WHERE len(words) > 0)),
g AS MATERIALIZED (SELECT r, i, n, array_to_string(words[i : i + n - 1], ' ') AS g FROM (SELECT d.*, z.n, unnest(range(1, len(words) - z.n + 2)) AS i FROM d JOIN (SELECT DISTINCT n FROM v) z ON len(words) >= z.n)),
h AS MATERIALIZED (SELECT g.r, g.i, g.n, v.item_id FROM g JOIN v USING (n, g)),
p AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM h) GROUP BY r),
q AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(p.n_hit, 0)::BIGINT AS n_hit, coalesce(q.n_items, 0)::BIGINT AS n_items, sha256(coalesce(q.items, '')) AS items_sha256, p.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN q USING (r)
"""
