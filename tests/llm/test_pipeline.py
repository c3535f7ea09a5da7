"""The whole pipeline against a brute-force version: plain Python over a small fixture whose quality is clear by construction."""

import collections
import hashlib
import re

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from quayside.llm.mixing import WEIGHTS

SHARED = "This line is shared by many documents"
ITEM = [f"item{k}" for k in range(14)]
SHORT = ["tiny", "benchmark", "entry"]


def rows():
    rng = np.random.default_rng(7)
    line = lambda n: " ".join(rng.choice([f"word{k}" for k in range(300)], n))
    texts = ["\n".join(line(20) for _ in range(3)) for _ in range(80)]
    for k in range(0, 80, 4):
        texts[k] += f"\n {SHARED.upper() if k % 8 else SHARED}\t\nshort"
    words = texts[1].split(" ")
    for k in (41, 42, 43):
        texts[k] = " ".join([*words[: k - 20], "changed", *words[k - 19 :]])
    texts[44] = texts[1]
    texts[10] += "\n" + " ".join(ITEM[:12]) + " and more"
    texts[11] = texts[11].replace(" ", " " + ", ".join(SHORT) + " ", 1)
    texts[12] = " ".join(ITEM) + " few others"
    junk = [" ".join(rng.choice(["$$$", "BUY!!", "###", "%%%"], 40)) for _ in range(40)]
    place = [(("en", "fr", None)[k % 3], ("src0", "src4", "src12", "src5")[k % 4]) for k in range(123)]
    return [(k, t, *place[k], len(t or "")) for k, t in enumerate([*texts, *junk, None, "", " \n"])]


def line_dedup(docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    holders = collections.defaultdict(set)
    for d, t in docs.items():
        for x in t.split("\n"):
            holders[key(x)].add(d)
    out = {}
    for d, t in docs.items():
        seen, stay = set(), []
        for x in t.split("\n"):
            k = key(x)
            if len(k) < 20 or len(holders[k]) < 10 or (min(holders[k]) == d and k not in seen):
                stay.append(x)
            seen.add(k)
        out[d] = "\n".join(stay)
    return {d: t for d, t in out.items() if t.split()}


def near_dedup(docs):
    sets = {}
    for d, t in docs.items():
        w = t.lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    group = {d: d for d in docs}
    for a in docs:
        for b in docs:
            if a < b and group[a] != group[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    return {d: t for d, t in docs.items() if group[d] == d}


def decontamination(docs, items):
    windows = {tuple(x[i : i + 10]) for x in items for i in range(max(1, len(x) - 9))}

    def hits(text):
        found = list(re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text))
        w = [m.group().lower() for m in found]
        return found, {j for v in windows for i in range(len(w) - len(v) + 1) if tuple(w[i : i + len(v)]) == v for j in range(i, i + len(v))}

    out = {}
    for d, t in docs.items():
        found, hit = hits(t)
        if len(hit) > 0.5 * len(found):
            continue
        while hit:
            first = [j for j in sorted(hit) if j - 1 not in hit]
            last = [j for j in sorted(hit) if j + 1 not in hit]
            for a, b in reversed(list(zip(first, last, strict=True))):
                t = t[: found[a].start()] + "\n" + t[found[b].end() :]
            found, hit = hits(t)
        if t.split():
            out[d] = t
    return out


def mixing(docs, place):
    weight = collections.defaultdict(lambda: 1.0, {(a, b): c for a, b, c in WEIGHTS})
    domain = {"src0": "web", "src4": "books", "src5": "books", "src12": "forum"}
    n = {d: len(t.split()) for d, t in docs.items()}
    leaf = {d: (domain[place[d][1]], place[d][0] or "", place[d][1]) for d in docs}
    tokens = collections.Counter()
    for d in docs:
        tokens[leaf[d]] += n[d]

    def grants(path, budget, level):
        if level == 3:
            return {path: budget}
        capacity = collections.Counter()
        for x, k in tokens.items():
            if x[:level] == path:
                capacity[x[level]] += 3 * k
        got, left = {}, dict(capacity)
        while left:
            x = (budget - sum(got.values())) / sum(weight["domain lang source".split()[level], c] for c in left)
            full = [c for c in left if left[c] <= x * weight["domain lang source".split()[level], c]]
            got |= {c: left.pop(c) for c in full}
            if not full:
                got |= {c: x * weight["domain lang source".split()[level], c] for c in left}
                break
        return {k: v for c, b in got.items() for k, v in grants((*path, c), b, level + 1).items()}

    out = []
    for x, grant in grants((), sum(tokens.values()) * 0.5, 0).items():
        whole, upto = int(grant / tokens[x] + 1e-9), 0
        for d in sorted((d for d in docs if leaf[d] == x), key=lambda d: hashlib.md5(f"11:{whole}:{d}".encode()).hexdigest()):
            upto += n[d]
            out += [(d, e, docs[d], len(docs[d]), n[d]) for e in range(whole + (upto <= grant - whole * tokens[x]))]
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    pd.DataFrame(rows(), columns=["doc_id", "text", "lang", "source", "n_chars"]).to_parquet(path / "documents.parquet")
    pd.DataFrame([(k, int(k < 80), 0) for k in range(120)], columns=["doc_id", "quality", "toxic"]).to_parquet(path / "labels.parquet")
    pd.DataFrame([(0, " ".join(ITEM)), (1, " ".join(SHORT)), (2, None)], columns=["item_id", "text"]).to_parquet(path / "benchmark.parquet")
    return str(path)


def test_run_equals_brute_force(spark, folder):
    place = {r[0]: r[2:4] for r in rows()}
    docs = line_dedup({r[0]: r[1] for r in rows() if r[0] < 80})
    assert sum(SHARED.lower() in t.lower() for t in docs.values()) == 1
    docs = near_dedup(docs)
    assert 1 in docs and not {41, 42, 43, 44} & {*docs}
    docs = decontamination(docs, [ITEM, SHORT])
    assert 12 not in docs and "item" not in docs[10] and "tiny" not in docs[11]
    got = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id, r.epoch, r.text, r.n_chars, r.n_tokens) for r in got.collect()) == sorted(mixing(docs, place))


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_long_lines_count_from_the_second_document_on(spark, limit):
    from quayside.llm.lines import drop_repeated_lines

    line = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    held = [(line("long", 51), range(2, 4)), (line("nine", 60), range(5, 14)), (line("edge", 50), range(1, 10)), (line("ten", 50), range(0, 10)), (line("solo", 70), range(3, 4))]
    texts = {d: "\n".join([f"only document {d} has this", *(f" {x.upper() if d % 2 else x}\t" for x, h in held if d in h)]) for d in range(14)}

    def brute(docs):
        key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
        holders = collections.defaultdict(set)
        for d, t in docs.items():
            for x in t.split("\n"):
                holders[key(x)].add(d)
        gone = lambda d, k: len(k) >= 20 and len(holders[k]) >= (2 if len(k.split()) > 50 else 10) and d != min(holders[k])
        return {d: "\n".join(x for x in t.split("\n") if not gone(d, key(x))) for d, t in docs.items()}

    want = brute(texts)
    assert [sum(x in t.lower() for t in want.values()) for x, _ in held] == [1, 1, 9, 1, 1]
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()} == want
    got = drop_repeated_lines(docs, min_docs=10, min_chars=20, long_words=50, filter_bits=1 << 19, broadcast_keys=limit)
    assert {r.doc_id: r.text for r in got.collect()} == want


def test_stages_with_odd_tables(spark, folder):
    names = ["n_lines", "n_dropped", "n_words", "n_hit", "items", "spans", "over_coverage", "score", "predicted", "class", "text_hash"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    twice = docs.union(docs.where("doc_id < 3"))
    for name in names:
        twice = twice.withColumn(name, F.concat(F.lit("mine "), F.col("doc_id").cast("string")))
    for stage, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, twice, folder)
        assert out.columns == twice.columns, stage
        kept = out.select("doc_id", *names).collect()
        assert kept and all(r[x] == f"mine {r.doc_id}" for r in kept for x in names), stage
        assert function(spark, twice.limit(0), folder).count() == 0, stage
    assert corpus_pipeline.mixing(spark, docs.limit(0), folder).count() == 0
