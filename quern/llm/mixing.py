"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws the exponential key ``-ln(u) / w`` from its hashed id ``u``
and its quality weight ``w``: a column that the caller gives (such as the
probability of a classifier), or the share of plain text without one. Tokens are
a column of the caller's too, and white-space separated words without one, which
SQL can count; a text without spaces is one word then. A source's token budget is its target share of the
whole budget. Complete epochs come first; the rest of a budget is filled with
the documents of smallest key, as far as the running sum of their tokens stays
within it.

Scale: source, tokens and key of each document are written once, so that the text
is read twice in all. No source is ever sorted by one task. Keys fall into ``BUCKETS`` ordered
buckets; tokens are summed by source and bucket, the small table of sums is
running-summed, and only the one bucket a source's budget ends in is sorted by
document. This gives one cut-off key a source, and the documents are then chosen
by a projection over the scan: their text isn't shuffled, as long as the
cut-offs are few enough to be broadcast (checked by a count; a shuffle join with
splitting of skewed keys otherwise).

Nulls and edges: a null source is a source of its own. A null or blank text has
no tokens; it costs nothing and is taken like any other row. Rows with equal key
(repeated ids) are taken or left together. A null id draws the key of the empty
string. A source without tokens is taken once for each whole epoch of 0, that is
never. Targets that no present source has leave every budget at 0: the sample is
empty. A weight that is null, NaN or under ``WEIGHT_FLOOR`` counts as that. Extra columns pass through ``mix`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import WORD_TOKENS_SQL, broadcast_if_small, fresh, materialise, word_tokens

ALPHA, BUDGET_SHARE, SEED, BUCKETS = 0.5, 0.8, "mix-1", 16384
WEIGHT_FLOOR = 0.05


def quality_weight(text: Column) -> Column:
    """Share of lower-case letters and blanks among the characters, squared, at least ``WEIGHT_FLOOR``."""
    t = F.coalesce(text, F.lit(""))
    plain = F.length(t) - F.length(F.regexp_replace(t, r"[\p{Ll} ]+", ""))
    return F.greatest(F.lit(WEIGHT_FLOOR), F.round(F.pow(plain / F.greatest(F.length(t), F.lit(1)), F.lit(2.0)), 6))


def _unit(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) from the id, the same in every run and engine."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|" + seed)))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def _bucket(key: Column) -> Column:
    """Grows with the key, also far out, where documents of low weight lie."""
    return F.floor(key / (key + 1) * BUCKETS).cast("int")


def _key(docs: DataFrame, seed: str, weight: Column | None) -> Column:
    w = quality_weight(F.col("text")) if weight is None else F.when(F.isnan(weight) | (weight < WEIGHT_FLOOR), WEIGHT_FLOOR).otherwise(F.coalesce(weight, F.lit(WEIGHT_FLOOR))).cast("double")
    return F.round(-F.log(_unit(docs["doc_id"], seed)) / w, 12)


def _keyed(docs: DataFrame, seed: str, weight: Column | None, tokens: Column | None) -> DataFrame:
    """source, tokens, key, bucket; later buckets hold greater keys."""
    n = word_tokens(F.col("text")) if tokens is None else F.coalesce(tokens, F.lit(0)).cast("long")
    out = docs.select(F.col("source"), n.alias("tokens"), _key(docs, seed, weight).alias("key"))
    return out.withColumn("bucket", _bucket(F.col("key")))


def cutoffs(docs: DataFrame, targets: dict[str, float] | None = None, budget_share: float = BUDGET_SHARE, seed: str = SEED, weight: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """source, epochs (complete), cutoff: the greatest key taken once more, null for none.

    targets: weight by source, 0 for all that it leaves out; without it a source
    weighs its tokens to the power ``ALPHA``. budget_share: the budget as a part of all tokens.
    """
    if any(not 0 <= w < float("inf") for w in (targets or {}).values()):
        raise ValueError("a target weight must be a number of at least 0")
    keyed = materialise(_keyed(docs, seed, weight, tokens))
    sums = materialise(keyed.groupBy("source", "bucket").agg(F.sum("tokens").alias("tokens")))
    totals = sums.groupBy("source").agg(F.sum("tokens").alias("total"))
    if targets is None:
        share = F.pow(F.col("total").cast("double"), F.lit(ALPHA))
    else:
        share = F.lit(0.0)
        for source, w in targets.items():
            share = F.when(F.col("source") == source, F.lit(float(w))).otherwise(share)
    totals = totals.withColumn("weight", share)
    every = totals.agg(F.sum("weight").alias("weights"), F.sum("total").alias("all"))  # one row
    budgets = totals.crossJoin(F.broadcast(every)).where(F.col("total") > 0)
    budgets = budgets.withColumn("budget", F.when(F.col("weights") > 0, F.floor(F.round(F.col("all") * budget_share * F.col("weight") / F.col("weights"), 3))).otherwise(0))
    budgets = budgets.select(F.col("source").alias("s"), F.floor(F.col("budget") / F.col("total")).cast("int").alias("epochs"), F.pmod("budget", "total").alias("rest"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("upto", F.sum("tokens").over(running))
    edge = sums.join(budgets, sums.source.eqNullSafe(budgets.s))
    first_over = F.min(F.when(F.col("upto") > F.col("rest"), F.struct("bucket", (F.col("upto") - F.col("tokens")).alias("before"))))
    edge = edge.groupBy("s", "epochs", "rest").agg(first_over.alias("e"))
    edge = broadcast_if_small(materialise(edge.select("s", "epochs", "rest", F.col("e.bucket").alias("b"), F.col("e.before").alias("before"))))
    # only the bucket that the budget ends in is sorted by document
    docs_there = keyed.join(edge, keyed.source.eqNullSafe(edge.s) & (keyed.bucket == edge.b))
    by_key = docs_there.groupBy("s", "before", "rest", "key").agg(F.sum("tokens").alias("tokens"))
    upto = F.col("before") + F.sum("tokens").over(Window.partitionBy("s").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = by_key.withColumn("upto", upto).where(F.col("upto") <= F.col("rest")).groupBy("s").agg(F.max("key").alias("last"))
    out = edge.alias("e").join(last.alias("l"), F.col("e.s").eqNullSafe(F.col("l.s")), "left")
    # without a document of the edge bucket, all keys under that bucket are in; its lower end is exclusive
    return out.select(F.col("e.s").alias("source"), "epochs", F.col("b").alias("edge_bucket"), F.col("last").alias("cutoff"))


def _epochs(docs: DataFrame, copies: str, targets: dict[str, float] | None, budget_share: float, seed: str, weight: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """docs with the number of times each is taken."""
    cuts = broadcast_if_small(materialise(cutoffs(docs, targets, budget_share, seed, weight, tokens)))
    s, epochs, b, last, key = (fresh(docs, n) for n in ("s", "epochs", "b", "last", "key"))
    # a shuffle by source would put the text of the largest one in a single task
    cuts = cuts.select(F.col("source").alias(s), F.col("epochs").alias(epochs), F.col("edge_bucket").alias(b), F.col("cutoff").alias(last))
    out = docs.withColumn(key, _key(docs, seed, weight))
    out = out.join(cuts, out["source"].eqNullSafe(cuts[s]))
    bucket = _bucket(F.col(key))
    once_more = F.col(b).isNull() | (bucket < F.col(b)) | ((bucket == F.col(b)) & F.coalesce(F.col(key) <= F.col(last), F.lit(False)))
    return out.withColumn(copies, F.col(epochs) + F.when(once_more, 1).otherwise(0)).drop(s, epochs, b, last, key).where(F.col(copies) > 0)


def mix(docs: DataFrame, targets: dict[str, float] | None = None, budget_share: float = BUDGET_SHARE, seed: str = SEED, weight: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """The sample, with the columns of docs: a document taken n times is n rows.

    weight: quality weight of a row; tokens: its length. Both are columns of docs or functions of them."""
    copies, i = fresh(docs, "copies"), fresh(docs, "i")
    out = _epochs(docs, copies, targets, budget_share, seed, weight, tokens)
    return out.withColumn(i, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source and how many times each document of the sample is taken."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return _epochs(docs, "copies", None, BUDGET_SHARE, SEED).select("doc_id", "source", "copies")


#: Targets of ``mix_to_targets``: the first takes several epochs, all that aren't named are left out.
TARGETS, TARGET_SHARE = {"src1": 3.0, "src2": 1.0, "src3": 0.5}, 0.3


def mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op3, to given targets: small sources are repeated, complete epochs first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return _epochs(docs, "copies", TARGETS, TARGET_SHARE, SEED).select("doc_id", "source", "copies")


def _sql(budget_share: float, targets: dict[str, float] | None = None) -> str:
    share = f"pow(CAST(sum(tokens) AS DOUBLE), {ALPHA})" if targets is None else f"CAST(CASE source {' '.join(f"WHEN '{k}' THEN {w}" for k, w in targets.items())} ELSE 0 END AS DOUBLE)"
    return rf"""
WITH w AS (SELECT doc_id, source, {WORD_TOKENS_SQL} AS tokens,
    (CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|{SEED}')[1:12] AS BIGINT) + 0.5) / CAST({1 << 48} AS DOUBLE) AS u,
    greatest({WEIGHT_FLOOR}, round(pow((length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[\p{{Ll}} ]+', '', 'g'))) / CAST(greatest(length(coalesce(text, '')), 1) AS DOUBLE), 2), 6)) AS weight FROM documents)
, k AS (SELECT *, round(-ln(u) / weight, 12) AS key FROM w)
, t AS (SELECT source, sum(tokens) AS total, {share} AS weight FROM k GROUP BY source)
, b AS (SELECT source, total, floor(round((SELECT sum(total) FROM t) * CAST({budget_share} AS DOUBLE) * weight / nullif((SELECT sum(weight) FROM t), 0), 3)) AS budget FROM t WHERE total > 0)
, c AS (SELECT k.doc_id, k.source, floor(budget / total) AS epochs, budget - total * floor(budget / total) AS rest,
    sum(tokens) OVER (PARTITION BY k.source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
    FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source)
, d AS (SELECT doc_id, source, CAST(epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS INTEGER) AS copies FROM c)
SELECT doc_id, source, copies FROM d WHERE copies > 0"""


SQL = {"op3_mix_sources": _sql(BUDGET_SHARE), "mix_to_targets": _sql(TARGET_SHARE, TARGETS)}
QUERIES = {"op3_mix_sources": op3_mix_sources, "mix_to_targets": mix_to_targets}
