"""Sharding by histogram sort: shards of near-equal bytes that are ranges of a sort key.

Keys are 16 bytes: a hash of the text and then the document's id, so equal texts lie side by side. Splitters are found
without moving a row: each round counts, in every partition, the exact bytes below a set of candidate keys, adds the
counts up, and narrows each splitter's interval to the two candidates around its target, until the bytes below it meet
the tolerance or the interval holds one key. Then each row goes to its range in a single exchange, and its slot is its
rank there.

Defined cases: a null text has no bytes (its size is the fixed 16) and the hash of an empty one; a null id sorts first;
rows with equal keys can't be parted by a splitter; an empty table gives an empty result; a hot text is no hot key, as
ids part its copies; a very long text is a row of its size like another; other columns are carried where asked for, and one
named like an output isn't read.

The driver holds the candidates of a round, ``probes`` for each splitter: 2.5 million keys of 16 bytes for 40,000 splitters.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.shared import drop_stash, stash

OVERHEAD = 16
WIDTH = 16


def _pack(number: int, low: int, span: int) -> bytes:
    """Key of a number of the dense key space hash * span + (id - low)."""
    high, rest = divmod(number, span)
    return high.to_bytes(8, "big") + (rest + low + 2**63).to_bytes(8, "big")


def _keys(first: pa.Array, second: pa.Array) -> tuple[bytes, int]:
    """Sortable 16-byte keys of two signed 64-bit columns, end to end, and their number."""
    flip = np.uint64(1 << 63)
    parts = [x.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ flip for x in (first, second)]
    return np.stack(parts, 1).astype(">u8").tobytes(), len(parts[0])


def _array(raw: tuple[bytes, int]) -> np.ndarray:
    return np.frombuffer(raw[0], f"S{WIDTH}", raw[1])


def counts_below(rows: DataFrame, probes: list[bytes]) -> np.ndarray:
    """Exact bytes of the rows (k1, k2, size) whose key is below each probe (sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(probes, f"S{WIDTH}")
        total = np.zeros(len(probes) + 1, np.int64)
        for batch in batches:
            at = np.searchsorted(edges, _array(_keys(batch.column(0), batch.column(1))), "right")
            total += np.bincount(at, batch.column(2).to_numpy(), len(total)).astype(np.int64)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), pa.array(total[filled])], ["i", "bytes"])

    found = np.zeros(len(probes) + 1, np.int64)
    parts = rows.select("k1", "k2", "size").mapInArrow(run, "i int, bytes bigint").groupBy("i").agg(F.sum("bytes"))
    for i, n in parts.collect():  # one row a probe at most
        found[i] = n
    return np.cumsum(found)[:-1]


def splitters(rows: DataFrame, targets: list[float], slack: float, probes: int = 64) -> list[bytes]:
    """A key for each target (ascending): rows below it have about target bytes, at most slack away where keys allow."""
    low, high = rows.agg(F.min("k2"), F.max("k2")).first()
    span = high - low + 1
    # interval of each splitter: its ends and the bytes below them
    total = rows.agg(F.sum("size")).first()[0]
    state = [[0, 2**64 * span, 0, total] for _ in targets]
    best = [(abs(t - 0), 0) for t in targets]
    for _ in range(40):
        open_ = [i for i, t in enumerate(targets) if best[i][0] > slack and state[i][1] - state[i][0] > 1]
        if not open_:
            break
        tried: dict[int, None] = {}
        for i in open_:
            a, b, _, _ = state[i]
            step = max(1, (b - a) // (probes + 1))
            tried |= dict.fromkeys(range(a + step, min(b, a + step * (probes + 1)), step))
        order = sorted(tried)
        below = counts_below(rows, [_pack(n, low, span) for n in order])
        below = below.tolist()
        for i in open_:
            # the counts ascend with the candidates: the two around the target are found by bisection
            k = bisect_right(below, targets[i])
            for n, have in zip(order[max(0, k - 1) : k + 1], below[max(0, k - 1) : k + 1]):
                best[i] = min(best[i], (abs(have - targets[i]), n))
                if have <= targets[i]:
                    if n > state[i][0]:
                        state[i][0], state[i][2] = n, have
                elif n < state[i][1]:
                    state[i][1], state[i][3] = n, have
            for n, have in (state[i][0::2], state[i][1::2]):  # the ends are candidates too
                best[i] = min(best[i], (abs(have - targets[i]), n))
    return [_pack(min(n, 2**64 * span - 1), low, span) for _, n in best]


def shard(
    docs: DataFrame,
    shards: int = 40,
    text: str = "text",
    key: str = "doc_id",
    tolerance: float = 0.001,
    rows_per_range: int = 100_000,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard[, carry]): shards of near-equal bytes.

    Shards of more than rows_per_range rows are cut into several ranges by further splitters, so that ranks are made
    in small tasks; ranks continue over a shard's ranges.
    """
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(key),
        F.xxhash64(value).alias("k1"),
        F.coalesce(F.col(key).cast("bigint"), F.lit(-(2**63))).alias("k2"),
        (F.octet_length(value) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(value.cast("binary")).alias("text_crc32"),
        *carry,
    )
    rows = stash(rows, "shard-keys")
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    ranges = max(1, -(-n // (shards * rows_per_range)))
    parts = shards * ranges
    edges = splitters(rows, [total * i / parts for i in range(1, parts)], tolerance * total / shards) if n else []
    edges.sort()

    @F.arrow_udf("int")
    def part(first: pa.Array, second: pa.Array) -> pa.Array:
        at = np.searchsorted(np.array(edges, f"S{WIDTH}"), _array(_keys(first, second)), "right")
        return pa.array(at.astype(np.int32))

    rows = rows.withColumn("_part", part("k1", "k2"))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    by_shard = Window.partitionBy(F.floor(F.col("_part") / ranges)).orderBy("_part")
    sizes = stash(sizes.select("_part", (F.sum("_n").over(by_shard) - F.col("_n")).alias("_before")), "shard-sizes")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("k1", "k2", "size", "text_crc32"))
    placed = rows.withColumn("_rank", rank).join(sizes, "_part")
    return placed.select(
        key,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.floor(F.col("_part") / ranges).cast("int").alias("shard"),
        (F.col("_before") + F.col("_rank") - 1).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *carry,
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, **options) -> None:
    """The whole rows of docs as Parquet, a folder for each shard, in slot order within a file."""
    carry = tuple(c for c in docs.columns if c not in (options.get("key", "doc_id"), "size", "text_crc32", "law", "shard", "slot", "grown_shard"))
    placed = shard(docs, shards, carry=carry, **options)
    placed.drop("law", "grown_shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
