"""Near-duplicate texts by an LSH forest over MinHash signatures, each link confirmed on the full shingle sets.

A forest has several orders of each signature: tree t's order begins at value t * depth. In each tree the rows are
sorted by their order, and neighbours in it are candidates by the length of their common prefix. How long it must be
is set by each region: a region of depth d is a run of rows with the same first d values, and a row's region is the
shallowest one that holds at most ``crowd`` rows.

1. Cells: to walk a tree in parallel, its rows are dealt by their first value; where more than ``ROOM`` rows share it,
   by their whole order. Cells are whole regions, so no run is cut, and none grows with the input.
2. Walk: each cell is sorted by the tree's order, common prefixes of neighbours are counted, and each row's region
   follows from the runs. The rows of a region are candidates of each other.
3. A region that is crowded at full depth gives candidates with its smallest id, and is then finished in blocks: its
   rows outside its largest component are compared with all its rows of other components. No row is cut off.

So rows that share the first ``depth`` values in any tree always meet. Depth and the number of trees follow from the
similarity asked for: the deepest trees for which a pair at the threshold misses each other in all of them with a chance
of at most ``LOSS``; for 80 percent 25 trees of depth 5 (4.9e-5; at 85 percent 4.3e-7).

Candidates pass a test on packed signature bits that a true link fails with a chance below 1e-8, then the sets are
compared. Texts of equal sets are one row throughout, so copies aren't expanded into pairs.

Defined cases: A-Z are lower-cased and words split at ASCII white space; a text with fewer than ``k`` words is one
shingle; a null text or one without words has an empty set and links with nothing; a very long text has a row like
another, its whole set is compared; ids are expected to be unique and not null: rows that repeat an id count as one
document, and a row without an id is kept, or a copy if its set has one; an empty table gives an empty result; other
columns of the input aren't read, whatever their names. Words and shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import broadcast_if_small, components, drop_stash, stash
from tessella.llm.wordhash import mix, shingle_hashes, texts, word_hashes

HASHES = 128
#: Largest chance that a pair at the threshold shares no full-depth prefix in any tree.
LOSS = 1e-4
#: Rows of a cell that one task sorts; cells of full depth that are larger are crowded regions.
ROOM = 512
_FACTORS = np.random.default_rng(0xF0).integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)
_NIBBLES = [f"s{i}" for i in range(HASHES // 16)]


def shape(percent: int) -> tuple[int, int]:
    """(trees, depth): the deepest trees whose loss at the threshold is at most LOSS."""
    s = percent / 100
    return next((HASHES // d, d) for d in (8, 7, 6, 5, 4, 3, 2, 1) if d == 1 or (1 - s**d) ** (HASHES // d) <= LOSS)


def matches(percent: int, chance: float = 1e-8) -> int:
    """Of the 128 four-bit values, those that two sets at the threshold share less often with at most this chance."""
    p = percent / 100 + (1 - percent / 100) / 16
    total, least = 0.0, 0
    while least < HASHES and (total := total + comb(HASHES, least) * p**least * (1 - p) ** (HASHES - least)) <= chance:
        least += 1
    return least


def signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest upper half of each multiple of the shingles."""
    out = np.full(HASHES, np.uint64(2**64 - 1))
    for i in range(0, len(shingles), 1024):
        out = np.minimum(out, (shingles[i : i + 1024, None] * _FACTORS).min(0))
    return (out >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, text: str, key: str, k: int) -> DataFrame:
    """(id, n_shingles, k1, k2, sig, s0..s7): a 128-bit digest of the set, its signature as bytes that sort like its
    values, and four bits of each value."""
    shifts = (np.arange(16, dtype=np.uint64) * np.uint64(4))[None, :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k1, k2, sig = [], [], [], []
            for _, data, offsets in texts(batch.column(1)):
                words, first = word_hashes(data, offsets)
                for i in range(len(offsets) - 1):
                    own = np.unique(shingle_hashes(words[first[i] : first[i + 1]], k))
                    n.append(len(own))
                    k1.append(own.sum(dtype=np.uint64))
                    k2.append(np.bitwise_xor.reduce(mix(own + np.uint64(1))))
                    sig.append(signature(own))
            sig = np.array(sig, np.uint32).reshape(-1, HASHES)
            packed = ((sig & np.uint32(15)).astype(np.uint64).reshape(-1, HASHES // 16, 16) << shifts[None]).sum(2, dtype=np.uint64)
            empty = pa.array(np.array(n, np.int64) == 0)
            digest = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (k1, k2)]
            digest = [pa.compute.if_else(empty, pa.scalar(None, pa.int64()), x) for x in digest]
            rows = pa.array([x.tobytes() for x in sig.astype(">u4")], pa.binary())
            columns = [batch.column(0), pa.array(n, pa.int64()), *digest, rows]
            columns += [pa.array(np.ascontiguousarray(packed[:, i]).view(np.int64)) for i in range(HASHES // 16)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_shingles", "k1", "k2", "sig", *_NIBBLES])

    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string"))
    return rows.mapInArrow(run, "id bigint, n_shingles bigint, k1 bigint, k2 bigint, sig binary, " + ", ".join(f"{s} bigint" for s in _NIBBLES))


def _sized(a: str, b: str, percent: int) -> Column:
    """The smaller set can make up enough of the union."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def cells(sets: DataFrame, trees: int, depth: int) -> tuple[DataFrame, DataFrame | None, list[DataFrame]]:
    """Rows (cell, tail, id, n) of each tree, rows (cell, id, hub) of regions that are crowded at full depth, and the
    stashed tables that both read.

    There are at most trees * rows / ROOM regions of more than ROOM rows, so their table joins without moving the rows."""
    orders = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("t"), F.substring("sig", t * (4 * depth) + 1, F.lit(4 * depth)).alias("tail")))
    rows = sets.select("id", "n", F.explode(orders).alias("x")).select("id", "n", "x.t", "x.tail")

    def large(keyed: DataFrame) -> DataFrame:
        sizes = keyed.groupBy("cell").agg(F.count("*").alias("m"), F.min("id").alias("hub"))
        return stash(sizes.where(F.col("m") > ROOM).select("cell", "hub"), "large")

    first = rows.withColumn("cell", F.xxhash64("t", F.substring("tail", 1, 4)))
    shallow = large(first)
    if depth == 1 or shallow.isEmpty():
        crowded = None if shallow.isEmpty() else first.join(shallow, "cell").select("cell", "id", "hub")
        return first.join(shallow.select("cell"), "cell", "left_anti").select("cell", "tail", "id", "n"), crowded, [shallow]
    joined = first.join(shallow.withColumnRenamed("hub", "far"), "cell", "left")
    deep = large(joined.where("far is not null").withColumn("cell", F.xxhash64("t", "tail")))
    # rows of a crowded first region are dealt by their whole order
    dealt = joined.withColumn("cell", F.when(F.col("far").isNull(), F.col("cell")).otherwise(F.xxhash64("t", "tail"))).join(deep, "cell", "left")
    crowded = None if deep.isEmpty() else dealt.where("hub is not null").select("cell", "id", "hub")
    return dealt.where("hub is null").select("cell", "tail", "id", "n"), crowded, [shallow, deep]


def walk(rows: DataFrame, depth: int, crowd: int, percent: int) -> DataFrame:
    """(a, b, cell) of rows (cell, tail, id, n) in the sorted order of each cell: candidates a < b of equal regions, with
    cell null; and rows (a, null, cell) of regions that are crowded at full depth, cell being the region then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            table = pa.table(batch) if kept is None else pa.concat_tables([kept, pa.table(batch)])
            cell = table["cell"].to_numpy()
            # the last cell may go on in the next batch
            cut = len(cell) - int((cell[::-1] != cell[-1]).argmax()) if cell[0] != cell[-1] else 0
            kept = table.slice(cut)
            if cut:
                yield from found(table.slice(0, cut))
        if kept is not None and len(kept):
            yield from found(kept)

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cell, ids, n = (table[c].to_numpy() for c in ("cell", "id", "n"))
        tail = np.frombuffer(b"".join(table["tail"].to_pylist()), ">u4").reshape(len(cell), depth)
        alike = np.zeros((len(cell), depth), bool)  # with the row before: the prefix up to this value is common
        alike[1:] = np.logical_and.accumulate((tail[1:] == tail[:-1]) & (cell[1:] == cell[:-1])[:, None], axis=1)
        region, open_ = np.full(len(cell), -1), np.ones(len(cell), bool)
        for d in range(depth):
            run_of = np.cumsum(~alike[:, d]) - 1
            fits = open_ & (np.bincount(run_of) <= crowd)[run_of]
            region[fits] = run_of[fits] * depth + d
            open_ &= ~fits
        a, b = [], []
        for o in range(1, min(crowd, len(cell))):
            i = np.flatnonzero((region[o:] == region[:-o]) & (region[o:] >= 0))
            if not len(i):
                break
            few, many = np.minimum(n[i], n[i + o]), np.maximum(n[i], n[i + o])
            i = i[100 * few >= percent * many]
            a.append(np.minimum(ids[i], ids[i + o]))
            b.append(np.maximum(ids[i], ids[i + o]))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], ["a", "b", "cell"])
        if open_.any():
            rest = np.flatnonzero(open_)
            # a region's number: its cell and the values it shares
            name = mix(cell[rest].view(np.uint64))
            for d in range(depth):
                name = mix(name + tail[rest, d].astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(ids[rest]), pa.nulls(len(rest), pa.int64()), pa.array(name.view(np.int64))], ["a", "b", "cell"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "cell").sortWithinPartitions("cell", "tail", "id")
    return dealt.mapInArrow(run, "a bigint, b bigint, cell bigint")


def forest(sets: DataFrame, crowd: int, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """Candidate pairs (a, b), a < b, and rows (key, id) of regions that are crowded at full depth."""
    trees, depth = shape(percent)
    rows, crowded, stashed = cells(sets, trees, depth)
    found = stash(walk(rows, depth, crowd, percent), "forest")
    pairs = found.where("b is not null").select("a", "b")
    rest = found.where("b is null").select(F.col("cell").alias("key"), F.col("a").alias("id"))
    hubs = rest.groupBy("key").agg(F.min("id").alias("hub"))
    spokes = rest.join(hubs, "key").select("key", "id", "hub")
    if crowded is not None:
        spokes = spokes.unionByName(crowded.select(F.col("cell").alias("key"), "id", "hub"))
    spokes = stash(spokes, "crowded")
    drop_stash(*stashed)
    if spokes.isEmpty():
        return pairs, None
    return pairs.unionByName(spokes.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))), spokes.select("key", "id")


def _likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose packed signatures and set sizes allow a link."""
    packed = [*_NIBBLES, "n"]
    one = sets.select(F.col("id").alias("a"), *[F.col(s).alias(f"a_{s}") for s in packed])
    two = sets.select(F.col("id").alias("b"), *[F.col(s).alias(f"b_{s}") for s in packed])
    differ = []
    for s in _NIBBLES:
        x = F.col(f"a_{s}").bitwiseXOR(F.col(f"b_{s}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differ.append(F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111))))
    near = HASHES - reduce(lambda p, q: p + q, differ) >= matches(percent)
    return pairs.join(one, "a").join(two, "b").where(near & _sized("a_n", "b_n", percent)).select("a", "b")


def wanted_texts(docs: DataFrame, ids: DataFrame, text: str, key: str) -> DataFrame:
    """(id, x) of the documents with these ids: the one shuffle of texts, the same at every size."""
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("x"))
    return stash(rows.join(ids.distinct().hint("merge"), "id", "left_semi").groupBy("id").agg(F.max("x").alias("x")), "texts")


def confirmed(pairs: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose shingle sets have 100 * intersection >= percent * union; rows are (id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            keep = np.zeros(n, bool)
            sides = (_sets(batch.column(c), k) for c in (2, 3))
            for i, (x, y) in enumerate(zip(*sides, strict=True)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select([0, 1]).filter(pa.array(keep))

    one = rows.select(F.col("id").alias("a"), F.col("x").alias("xa"))
    two = rows.select(F.col("id").alias("b"), F.col("x").alias("xb"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "xa", "xb")
    return stash(joined.mapInArrow(run, "a bigint, b bigint"), "links")


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    for _, data, offsets in texts(column, 1 << 19):
        words, first = word_hashes(data, offsets)
        for i in range(len(offsets) - 1):
            yield np.unique(shingle_hashes(words[first[i] : first[i + 1]], k))


def _shared(one: list[np.ndarray], two: list[np.ndarray], width: int = 1 << 14) -> np.ndarray:
    """Sizes of the intersections of each set of one with each of two, by products of incidence matrices, a slice of
    the shingles at a time."""
    values, at = np.unique(np.concatenate([*one, *two]), return_inverse=True)
    sizes = [len(s) for s in [*one, *two]]
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    out = np.zeros((len(one), len(two)), np.float32)
    for i in range(0, len(values), width):
        part = slice(*np.searchsorted(at, [i, i + width]))
        m = np.zeros((len(sizes), width), np.float32)
        m[row[part], at[part] - i] = 1
        out += m[: len(one)] @ m[len(one) :].T
    return out


def crowded_links(rest: DataFrame, labels: DataFrame, rows: DataFrame, k: int, percent: int, asks: int = 64, block: int = 256) -> DataFrame:
    """Links that regions crowded at full depth still lack: in each, the rows outside its largest component are
    compared with all rows of other components, in blocks, and only links come out.

    A row of an only component has no other to be compared with, so its text goes nowhere: the rows of a region's
    largest component are sent to the blocks of those outside of it, and these to the blocks of all."""
    own = rest.distinct().join(labels.withColumnsRenamed({"component_id": "c"}), "id", "left").select("key", "id", F.coalesce("c", "id").alias("c"))
    own = stash(own, "crowded")
    sizes = own.groupBy("key", "c").agg(F.count("*").alias("m"))
    sizes = sizes.groupBy("key").agg(F.max_by("c", F.struct("m", "c")).alias("top"), F.sum("m").alias("m"), F.max("m").alias("most"))
    sizes = sizes.where("m > most").withColumns({"asking": F.ceil((F.col("m") - F.col("most")) / asks), "blocks": F.ceil(F.col("m") / block)})
    own = own.join(broadcast_if_small(sizes.select("key", "top", "asking", "blocks")), "key").join(rows, "id")
    spread = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    members = own.withColumn("j", spread("blocks", 1)).withColumn("i", every("asking")).withColumn("ask", F.lit(False))
    asking = own.where("c <> top").withColumn("i", spread("asking", 2)).withColumn("j", every("blocks")).withColumn("ask", F.lit(True))
    columns = ["key", "i", "j", "ask", "id", "c", "x"]

    def run(table: pa.Table) -> pa.Table:
        ask, ids, c = (table[n].to_numpy() for n in ("ask", "id", "c"))
        sets = list(_sets(table["x"].combine_chunks(), k))
        p, q = np.flatnonzero(ask), np.flatnonzero(~ask)
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(p) and len(q):
            both = _shared([sets[i] for i in p], [sets[i] for i in q])
            n = np.array([len(s) for s in sets])
            linked = (100 * both >= percent * (n[p][:, None] + n[q][None] - both)) & (c[p][:, None] != c[q][None])
            x, y = np.nonzero(linked)
            a, b = np.minimum(ids[p[x]], ids[q[y]]), np.maximum(ids[p[x]], ids[q[y]])
        return pa.table({"a": a, "b": b})

    units = members.select(columns).unionByName(asking.select(columns)).groupBy("key", "i", "j")
    return stash(units.applyInArrow(run, "a bigint, b bigint"), "links")


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 5, percent: int = 80, crowd: int = 40
) -> DataFrame:
    """(key, n_shingles, component_id, kept) of each row of docs."""
    all_rows = stash(signatures(docs, text, key, k), "signatures")
    columns = ["sig", *_NIBBLES]
    sets = all_rows.where("k1 is not null and id is not null").groupBy("k1", "k2")
    sets = stash(sets.agg(F.min("id").alias("id"), F.first("n_shingles").alias("n"), *[F.first(c).alias(c) for c in columns]), "sets")
    pairs, rest = forest(sets, crowd, percent)
    likely = stash(_likely(pairs.distinct(), sets, percent), "likely")
    ids = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id")))
    rows = wanted_texts(docs, ids if rest is None else ids.unionByName(rest.select("id")), text, key)
    links = confirmed(likely, rows, k, percent)
    labels = components(links)
    if rest is not None:
        more = crowded_links(rest, labels, rows, k, percent)
        labels = components(more.unionByName(labels.toDF("a", "b")))
    labels = labels.withColumnRenamed("id", "_v")
    found = sets.select("k1", "k2", F.col("id").alias("_v")).join(labels, "_v", "left").select("k1", "k2", F.coalesce("component_id", "_v").alias("component_id"))
    found = stash(found, "components")
    drop_stash(rows, likely, links, sets)
    out = all_rows.select("id", "n_shingles", "k1", "k2").join(found, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "id")
    kept = F.coalesce(component == F.col("id"), F.col("component_id").isNull())
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), kept.alias("kept"))
