"""Best-fit packing of tokenised documents into sequences of at most ``capacity`` tokens.

Only the histogram of piece lengths reaches the driver: at most ``capacity`` numbers, however large the input. Bin
completion runs on it, with equal bins counted once: a bin is built around the largest length left, from its
undominated fillings, fullest first, and is used as often as the counts allow. Best-fit decreasing gives the first
incumbent; a branch whose waste can no longer beat the incumbent is cut, and a solution at the lower bound ends the
search. The search is bounded and says so: bins and bound are logged, and bin_completion() returns both. The plan
(patterns with multiplicities) then deals slots to the pieces by their rank within their length.

Defined cases: a null text is empty and has its end token only; a document longer than the capacity is cut into full
pieces and a rest; repeated rows are packed one by one; rows without a key are dealt by their text's checksum; an empty
table gives an empty result; other columns of the input aren't read, whatever their names.
"""

from __future__ import annotations

import logging
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.bpe import load, text_blocks
from tessella.llm.shared import drop_stash, stash

logger = logging.getLogger(__name__)

Pattern = tuple[int, list[tuple[int, int]]]  # multiplicity, (length, times) of one bin


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of the total length, of the total with lengths above half the capacity kept
    apart, and of dual feasible functions, which charge a length the share of a bin that its kind can't do without (of
    lengths above a third at most two share a bin, so each is charged a half, and so on)."""
    lengths = np.arange(len(counts))
    best = -(-int((counts * lengths).sum()) // capacity)
    for k in np.flatnonzero(counts[: capacity // 2 + 1]):
        large = counts[capacity - k + 1 :].sum()
        middle = counts[capacity // 2 + 1 : capacity - k + 1]
        room = int(middle.sum()) * capacity - int((middle * lengths[capacity // 2 + 1 : capacity - k + 1]).sum())
        small = int((counts[k : capacity // 2 + 1] * lengths[k : capacity // 2 + 1]).sum())
        best = max(best, int(large + middle.sum()) + max(0, -(-(small - room) // capacity)))
    for k in range(1, 33):
        # in units of 1 / (k * capacity): x where (k + 1) x is a multiple of the capacity, else floor((k + 1) x) / k
        whole = lengths * (k + 1) % capacity == 0
        charged = np.where(whole, lengths * k, lengths * (k + 1) // capacity * capacity)
        best = max(best, -(-int((counts * charged).sum()) // (k * capacity)))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing on the histogram: equal bins are one pattern."""
    groups: dict[int, list[Pattern]] = {}  # by room left
    free = np.zeros(capacity + 1, np.int64)

    def put(room: int, times: int, items: list[tuple[int, int]]) -> None:
        if times:
            groups.setdefault(room, []).append((times, items))
            free[room] += 1

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            rooms = np.flatnonzero(free[length:])
            if not len(rooms):
                each = capacity // length
                put(capacity - each * length, left // each, [(length, each)])
                if left % each:
                    put(capacity - left % each * length, 1, [(length, left % each)])
                break
            room = int(rooms[0]) + length
            times, items = groups[room].pop()
            free[room] -= 1
            each = min(room // length, left)
            bins = min(times, left // each)
            put(room - each * length, bins, [*items, (length, each)])
            put(room, times - bins, items)
            left -= bins * each
    return [p for x in groups.values() for p in x]


def fillings(counts: np.ndarray, room: int, allowed: int, width: int, budget: int) -> list[list[tuple[int, int]]]:
    """Up to width undominated fillings of room from the lengths left, of at most allowed waste, fullest first.

    A filling is dominated if a longer length that is left fits in place of one of its own, or if another one fits
    beside. Only the first budget partial fillings are looked at, longest lengths first.
    """
    lengths = np.flatnonzero(counts[: room + 1])
    found: list[tuple[int, list[int]]] = []
    seen = 0

    def undominated(items: list[int], waste: int) -> bool:
        used = dict.fromkeys(items, 0)
        for x in items:
            used[x] += 1
        for x in {0, *items}:
            for y in lengths[np.searchsorted(lengths, x, "right") :]:
                if y > x + waste:
                    break
                if counts[y] > used.get(int(y), 0):
                    return False
        return True

    stack: list[tuple[int, int, list[int]]] = [(room, room, [])]
    while stack and seen < budget and len(found) < width:
        left, most, items = stack.pop()
        seen += 1
        if left and left <= most and counts[left] > items.count(left):
            found.append((0, [*items, left]))
            continue
        options = lengths[: np.searchsorted(lengths, min(left, most), "right")]
        options = [int(y) for y in options[-width:] if counts[y] > items.count(int(y))]
        if not options and left <= allowed and undominated(items, left):
            found.append((left, items))
        stack += [(left - y, y, [*items, y]) for y in options]
    found.sort(key=lambda f: f[0])
    return [[(y, f[1].count(y)) for y in dict.fromkeys(f[1])] for f in found]


#: Width and budget of the rounds of the search: a bin's branches and the partial fillings looked at for them.
ROUNDS = ((6, 200), (12, 600))


@dataclass(frozen=True)
class Packing:
    """Patterns, their bins, and the bound: proved optimal where the two are equal."""

    patterns: list[Pattern]
    bins: int
    bound: int


def bin_completion(histogram: dict[int, int], capacity: int, steps: int = 1_000) -> Packing:
    """Patterns that hold each length as often as the histogram has it, in as few bins as the search finds.

    Rounds of the search widen what it looks at, and each goes on from the best packing so far; they end when it meets
    the lower bound. steps bounds the bins that a round builds; the incumbent, a whole packing at any time, is returned
    after the last one, with the bound that it may still be above."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] += n
    if not counts.any():
        return Packing([], 0, 0)
    bound = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    for width, budget in ROUNDS:
        if sum(p[0] for p in best) == bound:
            break
        best = search(counts, capacity, best, bound, width, budget, steps)
    found = Packing(best, sum(p[0] for p in best), bound)
    logger.info("%d bins of %d tokens, at least %d are needed", found.bins, capacity, found.bound)
    return found


def search(counts: np.ndarray, capacity: int, best: list[Pattern], bound: int, width: int, budget: int, steps: int) -> list[Pattern]:
    """A round of the depth-first search; the best packing that it or its start has."""
    size = sum(p[0] for p in best)
    total = int((counts * np.arange(capacity + 1)).sum())
    # each entry of the path is (fillings not tried yet, applied pattern)
    path: list[tuple[list[list[tuple[int, int]]], Pattern]] = []
    left, waste, bins = counts.copy(), 0, 0

    def open_node() -> list[list[tuple[int, int]]]:
        longest = int(np.flatnonzero(left)[-1])
        left[longest] -= 1
        allowed = (size - 1) * capacity - total - waste
        options = fillings(left, capacity - longest, allowed, width, budget)
        left[longest] += 1
        return [[(longest, 1), *f] if not f or f[0][0] != longest else [(longest, f[0][1] + 1), *f[1:]] for f in options][::-1]

    todo = open_node()
    while steps and size > bound:
        steps -= 1
        if todo:
            items = todo.pop()
            times = int(min(left[y] // n for y, n in items))
            each = capacity - sum(y * n for y, n in items)
            # as many equal bins as the waste that may still be lost allows
            if each:
                times = min(times, max(0, ((size - 1) * capacity - total - waste) // each))
            if times:
                for y, n in items:
                    left[y] -= times * n
                waste += each * times
                bins += times
                path.append((todo, (times, items)))
                if not left.any():
                    if bins < size:
                        best, size = [p for _, p in path], bins
                    todo = []
                    continue
                todo = open_node() if bins < size else []
            continue
        if not path:
            break
        todo, (times, items) = path.pop()
        for y, n in items:
            left[y] += times * n
        waste -= times * (capacity - sum(y * n for y, n in items))
        bins -= times
    return best


def slots(plan: list[Pattern], capacity: int) -> dict[str, np.ndarray]:
    """A row for each length of each pattern, by length: first rank, times a bin, first sequence, first offset."""
    rows, sequence = [], 0
    for times, items in plan:
        offset = 0
        for length, n in items:
            rows.append((length, times * n, n, sequence, offset))
            offset += length * n
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    ends = np.cumsum(table[:, 1])
    start = np.searchsorted(table[:, 0], np.arange(capacity + 2))
    before = np.concatenate([[0], ends])
    # rank r of length l is row number searchsorted(ends, before[start[l]] + r)
    return {"ends": ends, "base": before[start], "first": before[:-1], "each": table[:, 2], "sequence": table[:, 3], "offset": table[:, 4]}


def tokenized_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, text: str, key: str, with_ids: bool) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of whole texts with their end token, cut at capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        last = end_id.to_bytes(4, "little")
        for batch in batches:
            first, rows, crcs, raw = 0, [], [], []
            for block in text_blocks(batch.column(1)):
                ids, offsets = bpe.encode_block(block)
                flat, cut = ids.astype("<u4").tobytes(), offsets.tolist()
                for i, (a, b) in enumerate(zip(cut, cut[1:])):
                    own = flat[4 * a : 4 * b] + last
                    for k, at in enumerate(range(0, len(own), 4 * capacity)):
                        piece = own[at : at + 4 * capacity]
                        rows.append((first + i, k, at // 4, len(piece) // 4))
                        crcs.append(zlib.crc32(piece))
                        if with_ids:
                            raw.append(np.frombuffer(piece, "<i4"))
                first += len(block)
            table = np.array(rows, np.int64).reshape(-1, 4)
            columns = [batch.column(0).take(pa.array(table[:, 0])), pa.array(table[:, 1].astype(np.int32)), pa.array(table[:, 2]), pa.array(table[:, 3]), pa.array(crcs, pa.int64())]
            names = [key, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(raw, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(key), F.col(text).cast("string"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def pack(
    docs: DataFrame,
    path: str,
    capacity: int = 4096,
    end_id: int = 1,
    text: str = "text",
    key: str = "doc_id",
    with_ids: bool = False,
    rows_per_chunk: int = 20_000,
) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset[, ids]), a row for each piece.

    Pieces are ranked within their length by chunks of the key's hash, so a length that many documents share is
    spread over the chunks; the chunks' counts are added up beforehand.
    """
    pieces = stash(tokenized_pieces(docs, path, capacity, end_id, text, key, with_ids), "pieces")
    chunks = max(1, -(-pieces.count() // rows_per_chunk))
    pieces = pieces.withColumn("_chunk", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(chunks)).cast("int"))
    counts = stash(pieces.groupBy("length", "_chunk").agg(F.count("*").alias("_n")), "piece-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}  # at most capacity rows
    table = slots(bin_completion(histogram, capacity).patterns, capacity)
    earlier = F.sum("_n").over(Window.partitionBy("length").orderBy("_chunk")) - F.col("_n")
    counts = counts.select("length", "_chunk", earlier.alias("_earlier"))
    order = Window.partitionBy("length", "_chunk").orderBy(key, "piece", "ids_crc32")
    ranked = pieces.withColumn("_rank", F.row_number().over(order) - 1).join(counts, ["length", "_chunk"])

    @F.arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        length, rank = length.to_numpy(), rank.to_numpy()
        at = table["base"][length] + rank
        row = np.searchsorted(table["ends"], at, "right")
        nth, each = at - table["first"][row], table["each"][row]
        return pa.StructArray.from_arrays(
            [pa.array(table["sequence"][row] + nth // each), pa.array(table["offset"][row] + nth % each * length)], ["sequence_id", "offset"]
        )

    placed = ranked.withColumn("_at", place(F.col("length"), (F.col("_rank") + F.col("_earlier")).cast("bigint")))
    kept = [key, "piece", "start", "length", "ids_crc32", F.col("_at.sequence_id"), F.col("_at.offset")]
    return placed.select(*kept, *["ids"] * with_ids)
