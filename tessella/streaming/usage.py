"""Running usage of model calls, and changes of a record's phase, as stateful streams that can be stopped and started."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Phases after which a record's state is forgotten.
FINAL = ("done", "error")


def _commit(path: str):
    """Each micro-batch writes a folder of its own id, which a replay replaces."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def usage_stream(spark: SparkSession, calls_path: str, usage_path: str, checkpoint: str, schema: str | StructType, files: int = 4) -> None:
    """Count all call files (ts, purpose, prompt_tokens, completion_tokens, failed) that aren't counted yet.

    The state is a row for each month and purpose, whatever the number of calls; a month that begins starts at zero. A
    micro-batch hands on the rows that it changed, with their totals so far. Late calls go to their own month."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(calls_path)
    ok = ~F.coalesce("failed", F.lit(False))
    zero = lambda c: F.coalesce(F.when(ok, F.col(c)), F.lit(0.0)).cast("double")
    totals = rows.groupBy(F.date_format("ts", "yyyy-MM").alias("month"), F.coalesce("purpose", F.lit("")).alias("purpose")).agg(
        F.count_if(ok).alias("calls"),
        F.sum(zero("prompt_tokens")).alias("prompt_tokens"),
        F.sum(zero("completion_tokens")).alias("completion_tokens"),
        F.count_if(~ok).alias("failures"),
    )
    stream = totals.writeStream.outputMode("update").foreachBatch(_commit(usage_path)).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    stream.start().awaitTermination()


def usage_of(spark: SparkSession, usage_path: str) -> DataFrame:
    """(month, purpose, calls, tokens, failures), by month and purpose and by month (purpose "(all)"), as the last batch left them."""
    rows = spark.read.parquet(usage_path)
    last = rows.groupBy("month", "purpose").agg(F.max_by(F.struct("calls", "prompt_tokens", "completion_tokens", "failures"), "batch").alias("u")).select("month", "purpose", "u.*")
    found = last.groupingSets([("month",), ("month", "purpose")], "month", "purpose")
    sums = found.agg(F.sum("calls").alias("calls"), F.round(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")), 4).alias("tokens"), F.sum("failures").alias("failures"))
    return sums.select("month", F.coalesce("purpose", F.lit("(all)")).alias("purpose"), "calls", "tokens", "failures")


def phase_stream(spark: SparkSession, updates_path: str, changes_path: str, checkpoint: str, schema: str | StructType, files: int = 4, final: tuple[str, ...] = FINAL) -> None:
    """Of updates (record_id, seq, phase) hand on those only whose phase differs from the record's last one.

    A record's last phase and number are the state; it is dropped when the record has ended. Updates that come again or late
    (a number not above the last) are passed over."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(updates_path)
    kind = rows.schema["record_id"].dataType.simpleString()

    def changes(key: tuple[Any], parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        # a record's updates of one micro-batch, whose size maxFilesPerTrigger bounds
        own = pd.concat(list(parts)).sort_values("seq")
        phase, number = state.get if state.exists else ("", -1)
        own = own[own["seq"] > number].drop_duplicates("seq")
        if own.empty:
            return
        before = own["phase"].shift(fill_value=phase)
        if own["phase"].iloc[-1] in final:
            state.remove()
        else:
            state.update((own["phase"].iloc[-1], int(own["seq"].iloc[-1])))
        yield own[own["phase"] != before][["record_id", "seq", "phase"]]

    found = rows.groupBy("record_id").applyInPandasWithState(changes, f"record_id {kind}, seq long, phase string", "phase string, seq long", "append", "NoTimeout")
    stream = found.writeStream.outputMode("append").foreachBatch(_commit(changes_path)).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    stream.start().awaitTermination()


def changes_of(spark: SparkSession, changes_path: str) -> DataFrame:
    return spark.read.parquet(changes_path).drop("batch")
