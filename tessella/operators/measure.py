"""Retrieval metrics, comparisons, summaries and usage counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import fnv1a


def ranking_metrics(ranked: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg, mrr, recall) at k with linear gain; queries without a relevant row are left out."""
    order = Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")
    graded = qrels.where("grade > 0").withColumn("ideal", F.row_number().over(order))
    best = graded.groupBy("query_id").agg(
        F.sum(F.when(F.col("ideal") <= k, F.col("grade") / F.log2(F.col("ideal") + 1))).alias("idcg"), F.count("*").alias("relevant")
    )
    hits = ranked.where(F.col("rank") <= k).join(graded.select("query_id", "doc_id", "grade"), ["query_id", "doc_id"])
    got = hits.groupBy("query_id").agg(F.sum(F.col("grade") / F.log2(F.col("rank") + 1)).alias("dcg"), F.min("rank").alias("first"), F.count("*").alias("found"))
    rows = best.join(got, "query_id", "left")
    zero = F.lit(0.0)
    return rows.select(
        "query_id",
        F.round(F.coalesce(F.col("dcg") / F.col("idcg"), zero), 6).alias("ndcg"),
        F.round(F.coalesce(1 / F.col("first"), zero), 6).alias("mrr"),
        F.round(F.coalesce(F.col("found") / F.col("relevant"), zero), 6).alias("recall"),
    )


def token_f1(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, f1): best multiset overlap of predicted terms (query_id, terms) with the golds (query_id, gold_no, terms)."""
    counted = lambda rows, keys: rows.select(*keys, F.explode("terms").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n"))
    p, g = counted(predicted, ["query_id"]), counted(gold, ["query_id", "gold_no"])
    common = g.withColumnRenamed("n", "m").join(p, ["query_id", "term"]).groupBy("query_id", "gold_no").agg(F.sum(F.least("n", "m")).alias("c"))
    sizes = gold.select("query_id", "gold_no", F.size("terms").alias("g")).join(predicted.select("query_id", F.size("terms").alias("p")), "query_id")
    rows = sizes.join(common, ["query_id", "gold_no"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    # an empty answer agrees with an empty gold only
    f1 = F.when((F.col("g") == 0) | (F.col("p") == 0), (F.col("g") == F.col("p")).cast("double")).otherwise(2 * F.col("c") / (F.col("g") + F.col("p")))
    return rows.groupBy("query_id").agg(F.round(F.max(f1), 6).alias("f1"))


def paired_change(before: DataFrame, after: DataFrame, value: str) -> DataFrame:
    """(query_id, before, after, change) of questions that both sides have."""
    rows = before.select("query_id", F.col(value).alias("before")).join(after.select("query_id", F.col(value).alias("after")), "query_id")
    return rows.withColumn("change", F.round(F.col("after") - F.col("before"), 6))


def paired_bootstrap(changes: DataFrame, iterations: int = 2000, seed: int = 7, level: float = 0.95) -> DataFrame:
    """One row (n, mean_change, low, high): mean change and its interval over resamples.

    A resample's weights are drawn row by row (a Poisson variable of mean 1 from a hash of iteration and question), so
    a draw needs no index and the rows are never gathered."""
    rows = changes.select("query_id", "change", F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("i"))
    u = F.pmod(F.xxhash64("query_id", "i", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    # inverse of the Poisson(1) distribution function
    steps, p, total = [], 0.36787944117144233, 0.0
    for n in range(9):
        total += p
        steps.append((total, n))
        p /= n + 1
    weight = F.lit(9)
    for total, n in reversed(steps):
        weight = F.when(u < total, n).otherwise(weight)
    means = rows.withColumn("w", weight).groupBy("i").agg(F.try_divide(F.sum(F.col("w") * F.col("change")), F.sum("w")).alias("m"))
    edge = (1 - level) / 2
    ends = means.agg(F.percentile("m", F.lit(edge)).alias("low"), F.percentile("m", F.lit(1 - edge)).alias("high"))  # over the iterations
    return changes.agg(F.count("*").alias("n"), F.avg("change").alias("mean_change")).crossJoin(ends)  # one row each


def nearest_rank_percentiles(rows: DataFrame, group: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles (sorted[min(n - 1, floor(p / 100 * n))]) of each group, by rank and not by a list."""
    order = Window.partitionBy(*group).orderBy(value)
    kept = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    ranked = kept.select(*group, F.col(value).alias("v"), F.row_number().over(order).alias("r"))
    ranked = ranked.withColumn("n", F.count("*").over(Window.partitionBy(*group)))
    at = lambda p: F.least(F.col("n"), F.floor(F.col("n") * p / 100) + 1)
    return ranked.groupBy(*group).agg(*[F.max(F.when(F.col("r") == at(p), F.col("v"))).alias(name) for name, p in points.items()])


def quantile_summary(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """n, mean, median, p90, min and max of each group."""
    base = rows.groupBy(*group).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return base.join(nearest_rank_percentiles(rows, group, value, {"median": 50, "p90": 90}), group)


def batch_plan(rows: DataFrame, length: Column, size: int, group: list[str]) -> DataFrame:
    """Batches of size rows by ascending length: (.., pos, batch)."""
    order = Window.partitionBy(*group).orderBy("length", "pos")
    return rows.withColumn("length", length).withColumn("batch", F.floor((F.row_number().over(order) - 1) / size))


def half(key: Column) -> Column:
    """A or B by the parity of the key's FNV hash."""
    return F.when(fnv1a(key.cast("string")) % 2 == 0, "A").otherwise("B")


def usage(calls: DataFrame) -> DataFrame:
    """Per month, and per month and purpose: calls, tokens, failures; failed calls count apart."""
    month = F.date_format("ts", "yyyy-MM")
    rows = calls.select(month.alias("month"), "purpose", "tokens", "failed")
    found = rows.groupingSets([("month",), ("month", "purpose")], "month", "purpose")
    ok = ~F.col("failed")
    return found.agg(
        F.count_if(ok).alias("calls"),
        F.round(F.sum(F.when(ok, F.col("tokens")).otherwise(0.0)), 4).alias("tokens"),
        F.count_if("failed").alias("failures"),
    ).select("month", F.coalesce("purpose", F.lit("(all)")).alias("purpose"), "calls", "tokens", "failures")


def lab_summary(results: DataFrame, means: list[str], counts: list[str]) -> DataFrame:
    """Per configuration: number of questions, means (nulls skipped) and counts of true flags."""
    return results.groupBy("config_id").agg(
        F.count("*").alias("questions"),
        *[F.round(F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None))), 6).alias(f"mean_{c}") for c in means],
        *[F.count_if(F.col(c)).alias(f"n_{c}") for c in counts],
    )


def best_and_fastest(summary: DataFrame, quality: str, latency: str) -> DataFrame:
    """One row (best, fastest): ties go to the smaller configuration id."""
    by = lambda x: F.min_by("config_id", F.struct(x, "config_id"))
    return summary.agg(by(-F.col(quality)).alias("best"), by(F.col(latency)).alias("fastest"))
