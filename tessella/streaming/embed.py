"""Incremental embedding of new chunks with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessella.functions.vectors import quantize

KEYS = ("doc_id", "idx", "model")


def embed_stream(
    spark: SparkSession, chunks_path: str, vectors_path: str, checkpoint: str, schema: str | StructType, embed: Callable[[Column], Column], model: str, files: int = 4
) -> None:
    """Quantised vectors of all chunk files that aren't done yet; restarts go on where the checkpoint is.

    Each micro-batch writes a folder of its own id and replaces it when it is replayed, so a batch that failed half-way
    leaves no repeated row; the table's key is (doc_id, idx, model)."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(chunks_path)
    z = quantize(embed(F.col("text")))
    rows = rows.select("doc_id", "idx", F.lit(model).alias("model"), z.alias("z")).select(*KEYS, "z.q", "z.scale")

    def commit(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(list(KEYS)).write.mode("overwrite").parquet(f"{vectors_path}/batch={number}")

    stream = rows.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    stream.start().awaitTermination()


def vectors_of(spark: SparkSession, vectors_path: str) -> DataFrame:
    """The vector table: one row a key, the latest batch's."""
    rows = spark.read.parquet(vectors_path)
    latest = rows.groupBy(*KEYS).agg(F.max_by(F.struct("q", "scale"), "batch").alias("z"))
    return latest.select(*KEYS, "z.q", "z.scale")
