"""Intermediate tables in the cluster's shared folder, connected components of link tables, and ranks in hot groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessella.sources.stash import drop_stash, new_path, shared_dir, stash  # noqa: F401  for the operators

#: An id with more links than this is joined apart, by a small table of such ids.
HOT = 500
#: Rows of a table with a few numbers a row that may go to every executor.
SMALL = 100_000


def broadcast_if_small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df, marked for broadcast where it has at most ``most`` rows; a larger one is left to an ordinary join."""
    return F.broadcast(df) if df.count() <= most else df


def with_minimum(edges: DataFrame, low: DataFrame, hot: bool = True) -> DataFrame:
    """edges (u, v) with their u's m of low (u, m, n). Rows of an id with many links don't meet in one task: where there are
    such ids (hot), they are few (at most one for HOT links), and their small table joins apart."""
    if not hot:
        return edges.join(low.select("u", "m").hint("merge"), "u")
    few = low.where(F.col("n") > HOT).select("u", "m")
    rest = low.where(F.col("n") <= HOT).select("u", "m").hint("merge")
    return edges.join(few, "u").unionByName(edges.join(few, "u", "left_anti").join(rest, "u"))


def _minima(edges: DataFrame) -> tuple[DataFrame, bool]:
    """The stashed table (u, m, n) of each u's smallest v and number of links, and whether a u has more than HOT."""
    seen = Observation()
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return stash(low.observe(seen, F.max("n").alias("most")), "minima"), (seen.get["most"] or 0) > HOT


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected links (integers a, b): rows (id, component_id), component_id the smallest
    id that can be reached. Ids without a link to another id aren't returned.

    Alternates large-star and small-star steps (both are a grouped minimum and a join), so the number of rounds
    grows with the logarithm of the longest path. Links stay in Spark; each step's table is written to the shared
    folder, so that no plan holds a step twice, and only counts come to the driver. Hot ids are pre-aggregated in the
    minimum and joined apart. Links that already are stars (id, component_id) need no round.
    """
    found = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges, last = _observed(found)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low, hot = _minima(both)
        # v > u >= m holds for each row, so the links are oriented from the larger to the smaller id
        least = low.select("u", F.least("u", "m").alias("m"), "n")
        large = with_minimum(both.where("v > u"), least, hot).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stash(large, "links")
        drop_stash(low, edges)
        low, hot = _minima(large)
        small = with_minimum(large, low, hot).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, now = _observed(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        drop_stash(low, large)
        if now == last:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(
                edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
            )
        last = now
    raise RuntimeError(f"components didn't settle in {max_rounds} rounds")


def _observed(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The stashed table and its row count and checksum, counted while it is written."""
    seen = Observation()
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    out = stash(edges.observe(seen, F.count(F.lit(1)).alias("n"), digest.alias("digest")), "links")
    return out, seen.get


def ranked(rows: DataFrame, group: str, order: list[str | Column], name: str = "rank") -> DataFrame:
    """rows with their number (from 0) within the group in the given order; the result is a stashed table.

    A hot group isn't numbered by one task: rows are dealt by ranges of group and order, numbered within their range,
    and each range starts after the counts of the group's earlier ranges. Rows that are equal in all of it are told
    apart by their place in the input."""
    columns = [F.col(x) if isinstance(x, str) else x for x in order]
    keyed = rows.withColumns({f"_o{i}": c for i, c in enumerate(columns)}).withColumn("_u", F.monotonically_increasing_id())
    keys = [*[f"_o{i}" for i in range(len(columns))], "_u"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionByRange(parts, group, *keys).withColumn("_p", F.spark_partition_id())
    dealt = stash(dealt, "dealt")
    counts = dealt.groupBy(group, "_p").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_p")) - F.col("_n")
    counts = counts.select(F.col(group).alias("_g"), F.col("_p").alias("_q"), before.alias("_before"))
    own = F.row_number().over(Window.partitionBy(group, "_p").orderBy(*keys)) - 1
    out = dealt.withColumn("_r", own).join(counts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q")))
    out = stash(out.withColumn(name, F.col("_before") + F.col("_r")).select(*rows.columns, name), "ranked")
    drop_stash(dealt)
    return out
