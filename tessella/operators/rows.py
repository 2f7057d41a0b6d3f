"""Numbering rows within hot groups, and joins with small sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.sources.stash import drop_stash, stash

#: Rows of a table with a few numbers a row that may go to every executor.
SMALL = 100_000


def broadcast_if_small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df, marked for broadcast where it has at most ``most`` rows; a larger one is left to an ordinary join."""
    return F.broadcast(df) if df.count() <= most else df


def with_texts(rows: DataFrame, texts: DataFrame, keys: list[str], name: str = "chosen") -> DataFrame:
    """rows (narrow) joined with texts (keys, text, ..) last: rows are stashed, so that they are counted and joined without
    being made twice, and where they are few the texts aren't shuffled."""
    return texts.join(broadcast_if_small(stash(rows, name)), keys)


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
