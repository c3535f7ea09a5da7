"""The dealt operators on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quayside.llm import automaton, chat, contexttree, lines, minhash, mixing, quality, transducer, urls, weighted

DOCS = "doc_id long, text string, lang string, source string, n_lines string, score string, h string"
LONG = " ".join(f"w{k % 977}" for k in range(20_000))
BASE = [f"alpha{k} beta{k % 7} gamma{k % 5}" for k in range(40)]
ROWS = [
    (1, " ".join(BASE), "en", "a"), (2, " ".join(BASE), "en", "a"), (3, " ".join([*BASE[:-1], "other words here"]), "fr", None),
    (4, None, None, None), (5, "", "en", "a"), (6, " \t\n", "en", "b"), (7, LONG, "de", "b"), (8, "Short Text", "de", "b"),
    (8, "Short Text", "de", "b"), (None, "Short text", "en", "a"), (9, "one line\nOne Line \n\nlast", "en", "a"), (10, "ONE line\nfirst", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_near_duplicates(docs, none):
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, minhash.Sketching(width=4)).collect()}
    assert got[1].component_id == got[2].component_id == got[3].component_id == 1 and not got[3].kept
    assert got[4].n_shingles == got[5].n_shingles == got[6].n_shingles == 0 and got[4].kept and got[4].component_id == 4
    assert got[8].component_id == 8 and got[None].component_id is None and got[None].kept
    stay = minhash.drop_near_duplicates(docs, minhash.Sketching(width=4))
    assert stay.columns == docs.columns and {2, 3} & {r.doc_id for r in stay.collect()} == set()
    assert minhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_line_dedup_drops_all_or_keeps_first(docs, none, limit):
    got = {r.doc_id: r for r in lines.drop_repeated_lines(docs, min_docs=2, keep_first=False, broadcast_keys=limit, filter_bits=1 << 19).collect()}
    assert got[9].text == "\nlast" and got[9].n_dropped == 2 and got[9].n_lines == 4 and got[10].text == "first"
    assert got[4].text == "" and got[4].n_lines == 1 and got[7].text == LONG and got[8].text == ""
    first = {r.doc_id: r.text for r in lines.drop_repeated_lines(docs, min_docs=2, keep_first=True, broadcast_keys=limit, filter_bits=1 << 19).collect()}
    assert first[9] == "one line\n\nlast" and first[10] == "first" and first[1] == " ".join(BASE) and first[2] == ""
    assert lines.drop_repeated_lines(none, broadcast_keys=limit, filter_bits=1 << 19).count() == 0


def test_bloom_has_no_false_negatives():
    h = np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64)
    bloom = lines.Bloom(1 << 19)
    bloom.add(h[:2500])
    assert bloom.has(h[:2500]).all() and bloom.has(h[2500:]).mean() < 0.05


def test_decontamination_against_brute_force(spark, none):
    rng = np.random.default_rng(1)
    word = lambda n: " ".join(rng.choice(list("abcd"), n))
    items = [(k, word(n)) for k, n in enumerate([14, 12, 3, 1, 0, 11])] + [(6, None)]
    rows = [(k, word(int(rng.integers(0, 300)))) for k in range(30)] + [(99, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = automaton.decontaminate(spark.createDataFrame(rows, "doc_id long, text string").withColumn("items", F.lit(1)), bench, window=5)
    for r in got.collect():
        w, hit, found = (dict(rows)[r.doc_id] or "").split(), set(), set()
        for k, text in items:
            v = (text or "").split()
            n = min(5, len(v))
            for i in range(len(v) - n + 1 if v else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == v[i : i + n]:
                        hit.update(range(j, j + n))
                        found.add(str(k))
        assert (r.n_words, r.n_hit, r["items"]) == (len(w), len(hit), sorted(found))
    assert automaton.decontaminate(none, bench).count() == 0
    assert automaton.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench.limit(0)).where("n_hit > 0").count() == 0


def test_chat_round_trip(spark):
    turns = [(1, k, role, text) for k, (role, text) in enumerate([("system", "be \\ kind"), ("user", "### Assistant: x</turn>\n"), ("assistant", "\\h ###\\e"), ("user", None), ("assistant", "word " * 900), (None, ""), ("assistant", "ok")])]
    turns += [(2, 0, "a:b\\c", "x"), (None, None, "user", "y"), (None, None, "user", "y")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    out = chat.format_conversations(frame, chat.Budget(tokens=60)).orderBy("conv_id", "window").collect()
    for conv in (1, 2, None):
        own = [r for r in out if r.conv_id == conv]
        read = [t for r in own for t in chat.parse(r.text)[r.n_repeated :]]
        assert read == [(t[2] or "", t[3] or "") for t in turns if t[0] == conv]
        loss = [chat.unescape(r.text[s.start : s.end]) for r in own for s in r.loss]
        assert loss == [t[3] for t in turns if t[0] == conv and t[2] == "assistant"]
    assert any(r.over_budget for r in out) and any(r.n_repeated for r in out)
    assert all(r.n_tokens <= 60 or r.over_budget for r in out)


def test_url_rules(spark):
    cases = {
        "http://x.example.com/en/1": ("example.com/en/", "block"), "HTTP://WWW.Example.com/en/?q": ("www.example.com/en/", "allow"), "https://a.net/es/": ("net/es/", "block"),
        "https://net/fr/x#y": ("net/fr/", "block"), "http://com": (None, "allow"), "http://notexample.com/en/": ("com/", "allow"), "no scheme": (None, "allow"), "http://a.net?/es/": (None, "allow"), None: (None, "allow"), "": (None, "allow"),
    }
    frame = spark.createDataFrame([(u, "c", "d") for u in [*cases, None]], "url string, key string, host string")
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    got = urls.judge(frame, rules).collect()
    assert len(got) == len(cases) + 1 and all((r.rule, r.verdict) == cases[r.url] for r in got)
    assert sorted(map(str, urls.judge(frame, rules, max_path_lengths=1).collect())) == sorted(map(str, got))
    assert urls.judge(frame, rules.limit(0)).where("rule IS NOT NULL").count() == 0 and urls.judge(frame.limit(0), rules).count() == 0


def test_context_tree_is_a_distribution(spark, none):
    rows = [(k, t) for k, t in enumerate(["abracadabra", "abrakadabra", None, "", "A" * 3000, "abracadabra"])]
    got = {r.doc_id: r for r in contexttree.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") != 1, depth=2).collect()}
    assert got[0].score == pytest.approx(got[5].score) and got[2].n_tokens == 1 and got[2].score < 0 and got[1].n_known == 1
    counts = collections.Counter(w for k, t in rows if k != 1 for w in [*(t or "").lower().split(), None])
    assert got[0].base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (sum(counts.values()) + len(counts) + 1)) for w in ("abracadabra", None)))
    every = spark.createDataFrame([((98 << 16) | (97 << 8) | s, 5 if s == 114 else 0) for s in range(256)], "key long, n long")
    total = contexttree.gram_scores(every, 2).agg(F.sum(F.pow(F.lit(10.0), "value"))).first()[0]
    assert total == pytest.approx(1.0)
    assert contexttree.score(none, F.lit(True)).count() == 0


def test_kt_estimate(spark):
    p = lambda a, b: math.prod((k + 0.5) for k in range(a)) * math.prod((k + 0.5) for k in range(b)) / math.factorial(a + b)
    rows = [(float(a), float(b)) for a in range(6) for b in range(6)]
    for r in spark.createDataFrame(rows, "a double, b double").select("a", "b", contexttree.kt(F.col("a"), F.col("b")).alias("v")).collect():
        assert r.v == pytest.approx(math.log(p(int(r.a), int(r.b))), abs=1e-8)


def test_mixing_budgets_and_epochs(spark, docs, none):
    rows = [(k, "w " * 10, "en" if k % 2 else "fr", "big" if k < 90 else "small") for k in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("domain", F.lit("d")).withColumn("epoch", F.lit("clash"))
    weights = spark.createDataFrame([("source", "small", 50.0)], "level string, node string, weight double")
    out = mixing.mix(frame, weights, target_share=0.4, max_epochs=2)
    by = {r.source: r for r in out.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.max("epoch").alias("e")).collect()}
    assert by["small"].n == 200 and by["small"].e == 1 and by["big"].n == 200
    assert mixing.weighted_mix(docs).count() > 0 and mixing.weighted_mix(none).count() == 0


def test_mixing_gives_the_part_of_weight_0_to_others(spark):
    leaves = spark.createDataFrame([("en", "a", 900), ("en", "b", 100), ("fr", "c", 1000)], "lang string, source string, tokens long")
    weights = spark.createDataFrame([("source", "a", 0.0)], "level string, node string, weight double")
    got = mixing.leaf_budgets(leaves, weights, ("lang", "source"), 1000.0, 1)
    assert {r.source: r.grant for r in got.collect()} == pytest.approx({"b": 100, "c": 900})


def test_fingerprints_estimate_generalised_jaccard(docs, none):
    texts = pa.array([" ".join(BASE), " ".join([*BASE[:30], *BASE[:10]]), None, "", LONG])
    prints = weighted.fingerprints(texts, 256)

    def terms(t):
        w = t.lower().split()
        return collections.Counter(w) + collections.Counter(zip(w, w[1:]))

    a, b = (terms(texts[k].as_py()) for k in (0, 1))
    true = sum(min(a[x], b[x]) for x in a | b) / sum(max(a[x], b[x]) for x in a | b)
    assert abs((prints[0] == prints[1]).mean() - true) < 0.12 and (prints[2] == prints[3]).all() and (prints[0] != prints[2]).all()
    got = weighted.fingerprint(docs).collect()
    assert len(got) == len(ROWS) and got[0].fingerprint == got[1].fingerprint and weighted.fingerprint(none).count() == 0


def test_fingerprints_of_long_unrelated_texts_differ():
    own = lambda c: [f"{c}{k}" for k in range(40_000)]
    prints = weighted.fingerprints(pa.array([" ".join(x) for x in (own("a"), own("b"), own("a")[:30_000] + own("c")[:10_000], 2 * own("a"))]))
    alike = (prints[0] == prints).mean(axis=1)
    assert alike[0] == 1 and alike[1] < 0.05
    assert abs(alike[2] - 0.6) < 0.2 and abs(alike[3] - 0.5) < 0.2


def test_token_counts_equal_the_tokenizer(spark, docs, none):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["", " ", "a", "hello  world", "<s> x</s>\n\t", "日本語テキスト" * 50, "▁a▁ b", "x\0y", "ab" * 700, "😀 the end ", " " * 300, LONG]
    assert transducer.PieceTransducer(path).count(texts) == [len(x) for x in model.encode(texts)]
    tiny = transducer.PieceTransducer(path, most=50)
    assert [tiny.count([t])[0] for t in texts[:6]] == [len(x) for x in model.encode(texts[:6])]
    got = transducer.count_tokens(docs, path).collect()
    assert [r.n_tokens for r in got] == [len(model.encode(r[1] or "")) for r in ROWS] and transducer.count_tokens(none, path).count() == 0


def test_quality_learns_and_handles_odd_rows(spark, docs, none):
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(rng.choice(["fine", "words", "here"] if k % 2 else ["junk!!", "$$$", "BUY"], 30)), k % 2) for k in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = quality.fit(frame, frame.where("doc_id < 150").select("doc_id", "label"))
    got = quality.score(frame, model, threshold=0.5).where("doc_id >= 150").collect()
    assert all(r.predicted == r.label and 0 <= r.score <= 1 for r in got)
    odd = quality.score(docs, model).collect()
    assert len(odd) == len(ROWS) and odd[3].score == odd[4].score and quality.score(none, model).count() == 0
    empty = quality.fit(frame, frame.limit(0).select("doc_id", "label"))
    assert {r.score for r in quality.score(frame, empty).collect()} == {0.5}


def test_key_of_a_line():
    assert lines.key_of(b" \t A b\x0b") == b"a b"


def brute_context_tree(texts, learned, depth):
    """log10 probabilities by the definition: every node of every binary choice's tree in a dict, no packing, no parts."""
    edge = 0xFF
    counts = collections.defaultdict(lambda: [0, 0])
    lower = lambda t: [c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()]

    def steps(t):
        b = [edge] * depth + lower(t) + [edge]
        for i in range(depth, len(b)):
            yield tuple(reversed(b[i - depth : i])), b[i]

    for t, own in zip(texts, learned, strict=True):
        for ctx, sym in steps(t) if own else ():
            for k in range(8):
                for d in range(depth + 1):
                    counts[ctx[:d], (sym + 256) >> (k + 1)][(sym >> k) & 1] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    children = collections.defaultdict(set)
    for ctx, node in counts:
        if ctx:
            children[ctx[:-1], node].add((ctx, node))
    weighted = {}
    for key in sorted(counts, key=lambda x: -len(x[0])):
        own = kt(*counts[key])
        if len(key[0]) < depth:
            split = sum(weighted[c][0] for c in children[key])
            top = max(own, split)
            pw = top + math.log(math.exp(own - top) + math.exp(split - top)) - math.log(2)
            weighted[key] = pw, math.exp(own - math.log(2) - pw)
        else:
            weighted[key] = own, 1.0

    def choice(ctx, node):
        done = seen = 0.0
        rest = 1.0
        for d in range(depth + 1):
            key = (ctx[:d], node)
            if key not in weighted:
                if d == 0:
                    done, seen = 0.25, 0.5
                break
            n0, n1 = counts[key]
            w = weighted[key][1]
            done, seen, rest = done + rest * w * (n1 + 0.5) / (n0 + n1 + 1), seen + rest * w, rest * (1 - w)
        return done / seen

    def total(t):
        out = 0.0
        for ctx, sym in steps(t):
            for k in range(8):
                p = choice(ctx, (sym + 256) >> (k + 1))
                out += math.log10(p if (sym >> k) & 1 else 1 - p)
        return out

    return [total(t) for t in texts]


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_context_tree_scores_equal_brute_force(spark, depth):
    rng = np.random.default_rng(depth)
    texts = [" ".join(rng.choice(["the", "Then", "other", "né", "oth"], int(n))) for n in rng.integers(0, 40, 30)] + [None, "unseen zebra", "the the"]
    learned = [k % 3 != 0 for k in range(len(texts))]
    frame = spark.createDataFrame(list(zip(range(len(texts)), texts, learned, strict=True)), "doc_id long, text string, keys boolean").repartition(3)
    got = {r.doc_id: r for r in contexttree.score(frame, F.col("keys"), depth=depth, block_bytes=300).collect()}
    want = brute_context_tree(texts, learned, depth)
    assert [got[k].score for k in range(len(texts))] == pytest.approx(want, abs=1e-6, rel=1e-7)
    counts = collections.Counter(w for t, own in zip(texts, learned, strict=True) if own for w in [*(t or "").lower().split(), None])
    for k, t in enumerate(texts):
        words = [*(t or "").lower().split(), None]
        assert (got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (len(words), sum(counts[w] > 0 for w in words), sum(counts.values()))
        assert got[k].base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (sum(counts.values()) + len(counts) + 1)) for w in words))


def brute_near_duplicates(rows, width, percent=80):
    """component_id of each doc_id by comparing all pairs of texts; rows of one doc_id are linked."""
    sets = []
    for d, t in rows:
        w = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        sets.append((d, {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()))
    group = {d: d for d, _ in rows}
    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if a and b and group[d] != group[e] and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((group[d], group[e]))
                group = {k: low if g == high else g for k, g in group.items()}
    return group, [len(x) for _, x in sets]


def near_rows():
    rng = np.random.default_rng(5)
    word = lambda n: list(rng.choice([f"v{k}" for k in range(400)], n))
    rows, k = [], 0
    for _ in range(30):
        base = word(int(rng.integers(3, 90)))
        for _ in range(int(rng.integers(1, 7))):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(0, len(w)))] = "x" + str(int(rng.integers(0, 9)))
            rows.append((k, " ".join(w)))
            k += 1
    return [*rows, (900, None), (901, " \t "), (902, "one two"), (903, "ONE\ntwo"), (904, "one two three")]


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_op1_equals_brute_force(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(minhash, "_MEMBERS", 3)
    rows = near_rows()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    group, n = brute_near_duplicates(rows, 4)
    got = minhash.near_duplicates(spark.read.parquet(f"{tmp_path}/documents.parquet"), minhash.Sketching(width=4), broadcast_ids=limit) if not limit else minhash.op1_near_dedup(spark, str(tmp_path))
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == sorted((d, m, group[d], group[d] == d) for (d, _), m in zip(rows, n, strict=True))


def test_rows_of_one_doc_id_are_linked_and_no_text_is_lost(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (7, b), (7, b), (9, c), (9, c), (9, None), (4, b + " "), (5, c)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class", F.lit("x")).withColumn("text_hash", F.lit("y"))
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(frame).where("n_shingles > 0").collect()} == {(1, 1), (5, 1), (7, 1), (9, 1), (4, 1)}
    got = minhash.drop_near_duplicates(frame)
    assert got.columns == frame.columns
    assert sorted((r.doc_id, r.text or "") for r in got.collect()) == sorted([(1, a), (4, b + " "), (5, c), (9, "")])


def test_token_counts_of_texts_without_spaces():
    """Lanes that start inside a word: maps of several entry states, composed by the scan."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = np.random.default_rng(9)
    letters = list("aeiounrst日本語テキ1—\n")
    texts = ["".join(rng.choice(letters[:n], int(size))) for n in (1, 2, 3, 9, len(letters)) for size in (63, 64, 65, 129, 1000, 5000)]
    texts += ["a" * 3000, "the" * 999, "0123456789" * 300, "ab" * 700 + " " + "ba" * 700]
    made = transducer.PieceTransducer(path)
    want = [len(x) for x in model.encode(texts)]
    assert made.count(texts) == want
    assert [made.count([t])[0] for t in texts] == want


def test_op9_equals_its_sql_and_brute_force(spark, tmp_path):
    import duckdb
    import pandas as pd

    blank = " \t\n\x0b\x0c\r"
    nine, ten, same = (f"line of {x} holders" for x in ("nine", "ten", "one document"))
    rows = [(k, "\n".join([f"own {k}", *([f" {nine.upper()}\t"] if k < 9 else []), *([ten, ten] if k < 10 else []), *([same] * 12 if k == 3 else []), "", "é  "])) for k in range(12)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (3, ten)]
    pd.DataFrame(rows, columns=["doc_id", "text"]).to_parquet(tmp_path / "documents.parquet")
    key = lambda x: re.sub("[A-Z]", lambda m: m.group().lower(), x.strip(blank))
    split = [(t or "").split("\n") for _, t in rows]
    holders = collections.Counter(k for x in split for k in {key(y) for y in x} if k)
    want = []
    for (d, _), x in zip(rows, split, strict=True):
        stay = [y for y in x if holders[key(y)] < 10]
        want.append((d, len(x), len(x) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    assert holders[nine] == 9 and holders[ten] == 11
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    assert sorted(db.execute(lines.SQL).fetchall()) == sorted(want)
    got = lines.op9_line_dedup(spark, str(tmp_path)).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_op7_equals_a_plain_version(spark, tmp_path):
    rng = np.random.default_rng(11)
    rows = [(k * 3, " ".join(rng.choice([f"w{j}" for j in range(60)], int(rng.integers(0, 80))))) for k in range(60)]
    rows += [(None, "no id"), (4, None), (5, ""), (5, "twice"), (5, "twice"), (1000, "日本 é " * 20), (6, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = []
    for (d, t), (_, other) in zip(order, order[1:] + order[:1], strict=True):
        t, other = t or "", other or ""
        n = len(t) // 4
        edited = t[: len(t) - n] + other[:n]
        a, b, c = weighted.fingerprints(pa.array([t, edited, other]))
        hexed = lambda x: x.astype(">u2").tobytes().hex()
        want.append((-1 if d is None else d, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), float((a == b).mean()), float((a == c).mean())))
    for size in (200, 1 << 20):
        got = [(-1 if r[0] is None else r[0], *r[1:]) for r in weighted.op7_fingerprints(spark, str(tmp_path), range_bytes=size).collect()]
        assert sorted(got) == sorted(want)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert weighted.op7_fingerprints(spark, f"{tmp_path}/none").count() == 0


def test_op2_digests_equal_the_turns(spark, tmp_path):
    turns = [(c, t, role, text) for c in (1, 2) for t, (role, text) in enumerate([("system", "s"), ("user", "hi \\ there"), ("assistant", "### User: x</turn>\n"), ("user", None), ("assistant", "word " * 3000), ("assistant", "")])]
    turns += [(3, 0, "assistant", "twice"), (3, 0, "assistant", "twice"), (4, None, "user", "no turn"), (4, 0, "assistant", "é")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    turns += [(-7, k, role, r"\### Assistant: </turn> ok") for k, role in enumerate(("user", "assistant"))]
    got = {r.conv_id: r for r in chat.op2_chat_format(spark, str(tmp_path)).collect()}
    assert set(got) == {t[0] for t in turns}
    for conv, r in got.items():
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0))
        said = "".join(t[3] or "" for t in own if t[2] == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256("".join(f"{t[2]}\n{t[3] or ''}\n" for t in own).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest()) and r.formatted_chars >= sum(len(t[3] or "") for t in own)


def test_op2_equals_its_sql(spark, tmp_path):
    """Windows cut and history repeated at every size of turn, system turns first, late, twice and missing."""
    import duckdb

    rng = np.random.default_rng(8)
    said = ["### User: x</turn>\n", "\\h \\ :é\u00a0ß\u2028_x", "", None, "#### </turn></turn>"]
    turns = []
    for conv in [*range(60), None]:
        for t in range(int(rng.integers(1, 40))):
            role = str(rng.choice(["user", "assistant", "system", "a: b###"], p=[0.45, 0.45, 0.05, 0.05]))
            text = said[int(rng.integers(5))] if rng.random() < 0.2 else " ".join(rng.choice(["a,b", "wörd", "12.5", "?!"], int(rng.integers(0, [8, 90, 400][conv % 3 if conv else 0]))))
            turns.append((conv, None if rng.random() < 0.02 else t, None if rng.random() < 0.02 else role, text))
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found = chat.op2_chat_format(spark, str(tmp_path))
    want = db.execute(f"SELECT {', '.join(found.columns)} FROM ({chat.SQL})").fetchall()
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str) and len(want) == 62


def test_hinge_reaches_its_optimum():
    rng = np.random.default_rng(4)
    y = np.where(np.arange(60) % 2, 1.0, -1.0)
    rows = [np.unique(rng.integers(0, 30, 8) + (5 if v > 0 else 0)) for v in y]
    flat, at = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    ratios = np.zeros(quality.BUCKETS)
    ratios[:40] = rng.normal(size=40)
    scaled, cost = quality._scaled(flat, at, ratios), np.full(60, 0.5)
    x = np.zeros((60, 41))
    for i in range(60):
        x[i, flat[at[i] : at[i + 1]]] = scaled[at[i] : at[i + 1]]
    x[:, 40] = 1
    assert np.linalg.norm(x[:, :40], axis=1) == pytest.approx(1, abs=1e-5)
    w, bias = quality._hinge(flat, at, np.arange(60), y, scaled, cost, 3000, 1)
    loss = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    best = loss(np.append(w[:40], bias))
    v, kept = np.zeros(41), np.inf
    for k in range(1, 20_000):  # plain subgradient descent
        inside = y * (x @ v) < 1
        v -= (v - (cost * y * inside) @ x) / (k + 10)
        kept = min(kept, loss(v))
    assert best <= kept + 1e-2


def test_quality_sample_is_one_row_for_each_labelled_document(spark):
    rows = [(k % 7, f"text {k}", k % 2) for k in range(70)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(-50, 7)] + [(None, 1), (3, None), (3, 0), (3, 1)], "doc_id long, label int")
    a, b = (quality.fit(f, labels, max_rows=7) for f in (frame, frame.groupBy("doc_id").agg(F.min("text").alias("text"))))
    assert (a.weights == b.weights).all() and a.weights.any() and (a.slope, a.shift) == (b.slope, b.shift)


def test_odd_tables(spark):
    """Repeated rows, null ids, clashing column types and texts of several chunks for the operators that add columns."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    rows = [(1, LONG), (1, LONG), (None, "some words here now and then again one two"), (2, None), (3, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("n_tokens", "keys", "block", "n_words", "spans", "items", "score"):
        frame = frame.withColumn(name, F.array(F.lit("x")))
    got = contexttree.score(frame, F.lit(None).cast("boolean"), depth=3).collect()
    assert len(got) == 5 and len({r.score for r in got if r.doc_id == 1}) == 1 and all(r.learned for r in got)
    bench = spark.createDataFrame([(None, "some words here now and then again one two"), (7, "and then again")], "item_id long, text string")
    cut = automaton.decontaminate(frame, bench, window=5).collect()
    assert [r["items"] for r in cut if r.doc_id is None] == [["7"]] and [r.text for r in cut if r.doc_id is None] == ["\n"] and len(cut) == 5
    assert [r.text for r in cut if r.doc_id == 1] == [LONG] * 2 and [r.text for r in cut if r.doc_id == 2] == [None]
    counted = transducer.count_tokens(frame, str(public_tokenizers.path("piece_bpe_32k.model"))).collect()
    assert len(counted) == 5 and {r.n_tokens for r in counted if r.doc_id in (2, 3)} == {0}


@pytest.mark.parametrize("name", ["op1_near_dedup", "op3_decontamination"])
def test_sql_equals_the_query(spark, tmp_path, name):
    import duckdb
    import pandas as pd

    from quayside.llm import queries

    rng = np.random.default_rng(3)
    docs = near_rows() + [(1000 + k, " ".join(rng.choice(["a", "B", "c-d", "é"], int(rng.integers(0, 90))))) for k in range(30)]
    pd.DataFrame(docs, columns=["doc_id", "text"]).to_parquet(tmp_path / "documents.parquet")
    items = [(k, " ".join(rng.choice(["a", "b", "c", "d", "é"], n))) for k, n in enumerate([12, 10, 3, 0, 15])] + [(9, None)]
    pd.DataFrame(items, columns=["item_id", "text"]).to_parquet(tmp_path / "benchmark.parquet")
    db = duckdb.connect()
    for table in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    found = queries.QUERIES[name](spark, str(tmp_path))
    want = db.execute(f"SELECT {', '.join(found.columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) == len(docs)


def test_decontamination_in_parts_is_the_same(spark):
    rng = np.random.default_rng(6)
    word = lambda n: " ".join(rng.choice(list("abcdé"), n))
    bench = spark.createDataFrame([(k, word(n)) for k, n in enumerate([14, 12, 3, 1, 0, 11, 9, 9])] + [(9, None), (None, "a b")], "item_id long, text string")
    rows = [(k % 25, word(int(rng.integers(0, 120))) + "; é, " + word(4)) for k in range(30)] + [(99, None), (98, ""), (None, "zz zz")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("odd name", F.lit("x"))
    whole, parts = (automaton.decontaminate(frame, bench, window=5, max_item_bytes=n) for n in (1 << 20, 30))
    assert whole.schema.fieldNames() == parts.schema.fieldNames()
    key = lambda r: str(r.asDict(recursive=True))
    assert sorted(map(key, whole.collect())) == sorted(map(key, parts.collect())) and whole.where("n_hit > 0").count() > 20
    assert automaton.decontaminate(frame.limit(0), bench, max_item_bytes=30).count() == 0
