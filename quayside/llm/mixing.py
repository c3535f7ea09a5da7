"""Mixing sources to target weights: hierarchical token budgets, filled with prefixes of seeded epochs.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.store import keep

LEVELS = ("domain", "lang", "source")
#: Hexadecimal digits of the order key that name a bin of a leaf's epoch.
BIN_DIGITS = 3


def token_count(text: Column) -> Column:
    """Runs of signs other than [\\x20\\x09-\\x0D]."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def order_key(doc_id: Column, seed: int, epoch: Column) -> Column:
    """Where a document stands in an epoch: the MD5 digest of seed, epoch and id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _share(level: DataFrame, parent: list[str]) -> DataFrame:
    """Split each parent's ``budget`` among its children: ``grant`` is min(capacity, x * weight), x such that it is used up.

    Children sorted by capacity over weight fill up first; what they leave goes to their siblings by weight. ``level``
    has the parent columns, budget, weight and capacity; budget is at most the sum of capacities.
    """
    order = Window.partitionBy(*parent).orderBy("ratio", "node")
    up_to, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    x = (F.col("budget") - F.coalesce(F.sum("capacity").over(up_to), F.lit(0))) / F.sum("weight").over(rest)
    ranked = level.withColumn("ratio", F.col("capacity") / F.col("weight")).withColumn("x", x)
    fits = ranked.withColumn("x", F.max(F.when(F.col("x") <= F.col("ratio"), F.col("x"))).over(Window.partitionBy(*parent)))
    return fits.withColumn("grant", F.when(F.col("x").isNull() | (F.col("ratio") <= F.col("x")), F.col("capacity").cast("double")).otherwise(F.col("x") * F.col("weight")))


def leaf_budgets(leaves: DataFrame, weights: DataFrame, levels: tuple[str, ...], target: Column | float, max_epochs: int) -> DataFrame:
    """``leaves`` (levels, tokens) with grant, the tokens that each leaf gives.

    ``weights``: (level, node, weight); a node's weight is 1 where none is given. A node gets its parent's budget by
    weight; what it can't use (``max_epochs`` times its tokens) goes to its siblings by weight, and what they can't use
    either to its parent's siblings, and so on. Nodes of weight 0 are left out with their leaves before any is shared.
    """
    given = weights.groupBy("level", "node").agg(F.max("weight").cast("double").alias("weight"))
    for name in levels:
        own = given.where(F.col("level") == name).select(F.col("node").alias(name), F.col("weight").alias(f"{name}_weight"))
        leaves = leaves.join(own, name, "left").withColumn(f"{name}_weight", F.coalesce(f"{name}_weight", F.lit(1.0)))
    weighted = leaves.where(F.least(*[f"{x}_weight" for x in levels], F.lit(1.0)) > 0).withColumn("capacity", F.col("tokens") * max_epochs).where("capacity > 0")
    weighted = keep(weighted.withColumn("root", F.lit(0)), "weighted-leaves")
    root = weighted.agg(F.sum("capacity").alias("all"))
    now = root.select(F.lit(0).alias("root"), F.least(F.col("all").cast("double"), F.lit(target).cast("double")).alias("budget"))
    path = ["root"]
    for name in levels:
        nodes = weighted.groupBy(*path, name).agg(F.sum("capacity").alias("capacity"), F.max(f"{name}_weight").alias("weight"))
        now = _share(nodes.join(now, path).withColumn("node", F.col(name)), path).select(*path, name, F.col("grant").alias("budget"))
        path.append(name)
    return weighted.drop("root", "capacity", *[f"{x}_weight" for x in levels]).join(now.drop("root"), list(levels)).withColumnRenamed("budget", "grant")


def mix(docs: DataFrame, weights: DataFrame, *, target_share: float = 0.5, max_epochs: int = 3, seed: int = 11, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, the level columns, any more) that fill the mix, with n_tokens, epoch and
    leaf_tokens (the leaf's grant); columns of these names are replaced, and each row comes once for each epoch it is in.

    The mix has at most ``target_share`` of all tokens. A leaf (domain, lang, source; null is a node named '') gives
    whole epochs and then a prefix of the next: its documents in the order of ``order_key``, as long as their tokens
    stay within the grant. Rows of one doc_id stand together and come in or stay out together. Documents without
    tokens never come. Siblings of weight 0 or without tokens get nothing.

    Plan: narrow rows only are grouped and sorted. An epoch of a leaf is split into 16**BIN_DIGITS bins of its order
    key; sums of bins find the one where the prefix ends, and only that bin's documents are sorted, so no leaf is in
    one task. The texts move only if the table of prefix ends (a row for each leaf and epoch) is too large to be sent.
    """
    names = ("n_tokens", "epoch", "leaf_tokens")
    tree = [F.coalesce(F.col(x).cast("string"), F.lit("")).alias(f"_{x}") for x in levels]
    leaf = [f"_{x}" for x in levels]
    narrow = keep(docs.select(F.col("doc_id").alias("_id"), *tree, token_count(F.col("text").cast("string")).alias("_n")).where("_n > 0"), "narrow")
    leaves = narrow.groupBy(*leaf).agg(F.sum("_n").alias("tokens"))
    target = (leaves.agg(F.sum("tokens")).first()[0] or 0) * target_share
    own = weights.withColumn("level", F.concat(F.lit("_"), "level"))
    grants = keep(leaf_budgets(leaves, own, tuple(leaf), target, max_epochs), "grants")

    # grants cover `whole` epochs, and a part of the next
    whole = F.floor(F.col("grant") / F.col("tokens") + 1e-9)
    budgets = grants.select(*leaf, "tokens", "grant", whole.alias("whole"), (F.col("grant") - whole * F.col("tokens")).alias("part"))
    key = order_key(F.col("_id"), seed, F.col("whole"))
    placed = narrow.join(budgets, leaf).withColumn("key", key).withColumn("bin", F.substring("key", 1, BIN_DIGITS)).select(*leaf, "_n", "part", "key", "bin")
    bins = placed.groupBy(*leaf, "bin").agg(F.sum("_n").alias("n"), F.max("part").alias("part"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*leaf).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = bins.withColumn("before", before).where("before <= part AND before + n > part").select(*leaf, "bin", "before")
    keyed = placed.join(ends, [*leaf, "bin"]).groupBy(*leaf, "bin", "key").agg(F.sum("_n").alias("n"), F.max("part").alias("part"), F.max("before").alias("before"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(*leaf, "bin").orderBy("key"))
    last = keyed.withColumn("upto", upto).where("upto <= part").groupBy(*leaf).agg(F.max("key").alias("last"))
    # without a document of the bin, the prefix ends before it; without a bin, it has all (part = tokens) or none
    plan = budgets.join(ends.select(*leaf, "bin"), leaf, "left").join(last, leaf, "left")
    plan = keep(plan.select(*leaf, "grant", "whole", F.coalesce("last", "bin", F.lit("")).alias("last")), "plan")

    plain = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    rows = docs.select(*plain, *tree, token_count(F.col("text").cast("string")).alias("n_tokens")).where("n_tokens > 0").join(plan, leaf)
    inside = order_key(F.col("doc_id"), seed, F.col("whole")) <= F.col("last")
    count = F.col("whole").cast("int") + inside.cast("int")
    epochs = rows.where(count > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), count - 1)))
    return epochs.select(*plain, "n_tokens", F.col("epoch").cast("long").alias("epoch"), F.col("grant").alias("leaf_tokens"))


#: Domain of each source, and the target weights of the tree's nodes (others: 1).
DOMAIN_SQL = "CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN 'web' WHEN source IN ('src4', 'src5', 'src6', 'src7', 'src8', 'src9') THEN 'books' ELSE 'forum' END"
WEIGHTS = [("domain", "web", 2.0), ("domain", "books", 6.0), ("domain", "forum", 2.0), ("lang", "en", 4.0), ("lang", "fr", 2.0), ("source", "src0", 3.0), ("source", "src4", 8.0)]


def weighted_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` mixed by WEIGHTS; the domain comes from the source."""
    weights = docs.sparkSession.createDataFrame(WEIGHTS, "level string, node string, weight double")
    return mix(docs.withColumn("domain", F.expr(DOMAIN_SQL)), weights, **options)


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return weighted_mix(docs).select("doc_id", "domain", "lang", "source", "epoch", "n_tokens")


def _sql(seed: int = 11, max_epochs: int = 3, target_share: float = 0.5) -> str:
    def share(name: str, parent: str, above: str) -> str:
        """The level's nodes with their grants, from the budgets of the level above."""
        path = ", ".join(x for x in (parent, name) if x)
        part = f"PARTITION BY {parent}" if parent else ""
        on = f"USING ({parent})" if parent else "ON true"
        return f"""
{name}_n AS (SELECT {path}, sum(tokens * {max_epochs}) AS capacity FROM leaves GROUP BY {path}),
{name}_r AS (SELECT n.*, u.grant_ AS budget, coalesce(w.weight, 1.0)::DOUBLE AS weight, capacity / coalesce(w.weight, 1.0)::DOUBLE AS ratio
  FROM {name}_n n JOIN {above} u {on} LEFT JOIN weights w ON w.level = '{name}' AND w.node = n.{name} WHERE capacity > 0),
{name}_x AS (SELECT *, (budget - coalesce(sum(capacity) OVER ({part} ORDER BY ratio, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER ({part} ORDER BY ratio, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x FROM {name}_r),
{name}_f AS (SELECT *, max(CASE WHEN x <= ratio THEN x END) OVER ({part}) AS fit FROM {name}_x),
{name}_g AS (SELECT {path}, CASE WHEN fit IS NULL OR ratio <= fit THEN capacity::DOUBLE ELSE fit * weight END AS grant_ FROM {name}_f),"""

    rows = ", ".join(f"('{a}', '{b}', {c})" for a, b, c in WEIGHTS)
    return rf"""
WITH weights(level, node, weight) AS (VALUES {rows}),
d AS (SELECT doc_id, lang, source, {DOMAIN_SQL} AS domain, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, sum(n_tokens) AS tokens FROM d WHERE n_tokens > 0 GROUP BY ALL),
top AS (SELECT least(sum(tokens * {max_epochs})::DOUBLE, sum(tokens)::DOUBLE * {target_share}) AS grant_ FROM leaves),
{share("domain", "", "top")}{share("lang", "domain", "domain_g")}{share("source", "domain, lang", "lang_g")}
g AS (SELECT domain, lang, source, grant_, floor(grant_ / tokens + 1e-9)::BIGINT AS whole, grant_ - floor(grant_ / tokens + 1e-9) * tokens AS part
  FROM source_g JOIN leaves USING (domain, lang, source)),
k AS (SELECT d.*, g.whole, g.part, md5('{seed}:' || g.whole || ':' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM d JOIN g ON d.domain = g.domain AND coalesce(d.lang, '') = g.lang AND coalesce(d.source, '') = g.source WHERE n_tokens > 0),
s AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, coalesce(lang, ''), coalesce(source, '') ORDER BY key) AS upto FROM k),
e AS (SELECT *, unnest(range(whole + (upto <= part)::BIGINT)) AS epoch FROM s)
SELECT doc_id, domain, lang, source, epoch, n_tokens FROM e
"""


SQL = _sql()
