"""Near-duplicate vectors by NN-descent, within equal labels.

1. Vectors that are equal with equal labels become one vertex with a weight.
2. Sorted random-projection codes give each vertex a first list of ``k`` neighbours.
3. NN-descent rounds: each vertex gathers the vectors of its neighbours and of those that name it, and every pair of
   them that beats one of the two lists enters it. Rounds end when the links in the lists grow no more.
4. A list that is full of links is saturated and may lack further ones: all members of its component are compared with
   all rows of their label that the angle to a block's centre doesn't exclude, which yields link counts and joined
   components, not pairs. A list that isn't full of links has lost none that was found.
5. An audit compares vertices with all rows of their label until 200 with links are seen, or 64,000 without that many;
   while the mean over them of the share of their links found is below ``recall``, the search goes on with twice the
   projections. After ``tries`` searches below it, every row is compared as in 4, and nothing is left to chance.

Links are pairs of double-precision cosine at or above the threshold; nothing below it links.

Defined cases: a vector that is null, zero, or has null or non-finite components, or whose label or id is null, links
with nothing and is kept; vectors of different lengths aren't compared; repeated rows are vectors of their own that
link with each other; components of any size are compared, as lengths are taken out without squaring them first; an
empty table gives an empty result; other columns of the input aren't read, whatever their names. Equal vectors are found by
two 64-bit hashes; should two different vectors share the one that names them, the run stops with an error.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.shared import components, drop_stash, stash

logger = logging.getLogger(__name__)

BITS = 32
CHUNK = 40
BLOCK = 256
WIDE = 2048
EDGE = "v bigint, u bigint, s double"


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest component is taken out first, so that no square over- or underflows."""
    x = x / np.abs(x).max(-1, keepdims=True)
    return x / np.sqrt((x * x).sum(-1, keepdims=True))


def _edges(v: np.ndarray, u: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v), pa.array(u), pa.array(s)], ["v", "u", "s"])


def valid(vector: Column) -> Column:
    """Vectors that can be compared."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def projected(vertices: DataFrame, trees: range, dim: int, near: int = 6, best: int = 4) -> DataFrame:
    """Edges (v, u, s) between neighbours in the sorted order of each tree's code: the best of near to each side."""

    @F.arrow_udf("array<bigint>")
    def codes(column: pa.Array) -> pa.Array:
        x = _matrix(column)
        weights = (1 << np.arange(BITS, dtype=np.int64))[::-1]
        out = [((x @ np.random.default_rng([t, 5]).standard_normal((dim, BITS))) > 0) @ weights for t in trees]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(trees)), pa.array(np.stack(out, 1).ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            table = pa.table(batch) if kept is None else pa.concat_tables([kept, pa.table(batch)]).combine_chunks()
            kept = table.slice(max(0, len(table) - near))
            tree, group, v = (table[c].to_numpy() for c in ("t", "g", "v"))
            x = _unit(_matrix(table["x"].combine_chunks()))
            n = len(v)
            sims = np.full((n, 2 * near), -2.0)
            for o in range(1, min(near + 1, n)):
                same = (tree[o:] == tree[:-o]) & (group[o:] == group[:-o])
                s = np.where(same, np.einsum("ij,ij->i", x[o:], x[:-o]), -2.0)
                sims[:-o, o - 1] = s
                sims[o:, near + o - 1] = s
            step = np.concatenate([np.arange(1, near + 1), -np.arange(1, near + 1)])
            top = np.argpartition(-sims, best - 1, axis=1)[:, :best]
            row = np.repeat(np.arange(n), best)
            s = sims[row, top.ravel()]
            ok = s > -2
            yield _edges(v[row[ok]], v[(row + step[top.ravel()])[ok]], s[ok])

    rows = vertices.withColumn("c", codes("x")).select("v", "g", "x", F.posexplode("c").alias("t", "c"))
    rows = rows.repartitionByRange("t", "g", "c", "v").sortWithinPartitions("t", "g", "c", "v")
    return rows.select("t", "g", "v", "x").mapInArrow(run, EDGE)


def best_lists(edges: DataFrame, k: int) -> DataFrame:
    """The k best neighbours of each vertex of edges (v, u, s, fresh)."""
    edges = edges.groupBy("v", "u").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("v").orderBy(F.desc("s"), "u")
    return edges.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def descend(lists: DataFrame, vertices: DataFrame, k: int, seed: int, best: int = 4) -> DataFrame:
    """One round: pairs of a vertex's neighbours (both ways), at least one of them fresh, that beat one of their lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            table = pa.table(batch) if kept is None else pa.concat_tables([kept, pa.table(batch)]).combine_chunks()
            last = (table["c"].to_numpy() == table["c"][-1].as_py()) & (table["h"].to_numpy() == table["h"][-1].as_py())
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            kept = table.slice(cut)
            if cut:
                yield from join(table.slice(0, cut))
        if kept is not None and len(kept):
            yield from join(kept)

    def join(table: pa.Table) -> Iterator[pa.RecordBatch]:
        c, h, m, low, fresh = (table[n].to_numpy() for n in ("c", "h", "m", "low", "fresh"))
        x = _unit(_matrix(table["x"].combine_chunks()))
        start = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (h[1:] != h[:-1])))
        size = np.diff(np.append(start, len(c)))
        for width in (4, 8, 16, 32, 64, 128):
            own = np.flatnonzero((size <= width) & (size > width // 2) & (size > 1) | (size > 128) & (width == 128))
            for i in range(0, len(own), 1 + (1 << 20) // width**2):
                part = own[i : i + 1 + (1 << 20) // width**2]
                # members of each group, padded; a rare larger group loses none: the rest is a further group
                for first in range(0, int(size[part].max()), width) if len(part) else ():
                    at = start[part][:, None] + first + np.arange(width)[None]
                    there = at < (start + size)[part][:, None]
                    at = np.where(there, at, 0)
                    y = x[at]
                    s = y @ y.transpose(0, 2, 1)
                    s[~(there[:, :, None] & there[:, None, :])] = -2
                    s[:, np.arange(width), np.arange(width)] = -2
                    f = fresh[at] > 0
                    s[~(f[:, :, None] | f[:, None, :])] = -2
                    s[s <= low[at][:, :, None]] = -2
                    top = np.argpartition(-s, min(best, width) - 1, axis=2)[:, :, :best]
                    value = np.take_along_axis(s, top, 2)
                    a = np.broadcast_to(m[at][:, :, None], top.shape)
                    b = np.take_along_axis(np.broadcast_to(m[at][:, None, :], s.shape), top, 2)
                    ok = (value > -2) & (a != b)
                    yield _edges(a[ok], b[ok], value[ok])

    low = lists.groupBy("v").agg(F.when(F.count("*") >= k, F.min("s")).otherwise(-2.0).alias("low"))
    members = lists.select(F.col("v").alias("c"), F.col("u").alias("m"), "fresh").unionByName(lists.select(F.col("u").alias("c"), F.col("v").alias("m"), "fresh"))
    members = members.groupBy("c", "m").agg(F.max("fresh").alias("fresh"))
    # a vertex that many others name is met in chunks
    parts = members.groupBy("c").agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
    members = members.join(parts, "c").withColumn("h", F.pmod(F.xxhash64("m", F.lit(seed)), F.col("parts")).cast("int"))
    known = vertices.select("v", "x").join(low, "v", "left").select(F.col("v").alias("m"), "x", F.coalesce("low", F.lit(-2.0)).alias("low"))
    rows = members.join(known, "m").select("c", "h", "m", "fresh", "low", "x")
    partitions = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, "c", "h").sortWithinPartitions("c", "h").mapInArrow(run, EDGE)


def dense_counts(vertices: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Links of the dense rows of labels (v, component, dense) with all rows of their label, as rows (v, n, a, b):
    n is the weight of the rows that v links with (of the dense ones only, if v isn't dense), or a and b are components
    that a link joins; a row without a component is one of its own.

    Each component is dealt into blocks of about BLOCK rows. A row that links with a member of a block is within the
    block's radius and the threshold's angle of the block's centre; the rows for which that holds meet the block.
    """
    kind = vertices.schema["x"].dataType.simpleString()
    rows = vertices.join(labels, "v", "left").select("g", "v", "x", "w", F.coalesce("component", "v").alias("c"), F.coalesce("dense", F.lit(False)).alias("dense"))
    rows = stash(rows, "rows")
    spread = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    blocks = rows.where("dense").groupBy("c").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    members = rows.where("dense").join(blocks, "c").withColumn("block", F.xxhash64("c", spread("v", "nb")))
    members = stash(members.select("block", "g", "v", "x", "w", "c", "dense"), "members")

    def centre(table: pa.Table) -> pa.Table:
        x = _unit(_matrix(table["x"].combine_chunks()))
        mean = x.mean(0)
        mean = (mean if mean @ mean > 1e-12 else x[0]).astype(np.float32 if kind == "array<float>" else np.float64)
        r = np.arccos(np.clip(x @ _unit(mean.astype(np.float64)), -1, 1)).max()
        return pa.table({"block": table["block"][:1], "g": table["g"][:1], "x": pa.array([mean], table["x"].type), "r": pa.array([r])})

    centres = stash(members.groupBy("block").applyInArrow(centre, f"block bigint, g bigint, x {kind}, r double"), "centres")
    sizes = centres.groupBy("g").agg(F.ceil(F.count("*") / WIDE).cast("int").alias("nj"))
    sizes = sizes.join(rows.groupBy("g").agg(F.ceil(F.count("*") / WIDE).cast("int").alias("ni")), "g")
    one = rows.join(sizes, "g").withColumn("i", spread("v", "ni")).withColumn("j", every("nj")).select("g", "i", "j", F.col("v").alias("id"), "x", F.lit(None).cast("double").alias("r"))
    two = centres.join(sizes, "g").withColumn("j", spread("block", "nj")).withColumn("i", every("ni")).select("g", "i", "j", F.col("block").alias("id"), "x", "r")
    angle = float(np.arccos(np.clip(threshold, -1, 1)))

    def meet(table: pa.Table) -> pa.Table:
        r, ids = table["r"].to_numpy(), table["id"].to_numpy()
        x = _unit(_matrix(table["x"].combine_chunks()))
        own, to = np.flatnonzero(np.isnan(r)), np.flatnonzero(~np.isnan(r))
        least = np.cos(np.minimum(np.pi, r[to] + angle)) - 1e-7  # rounding of the radius
        v, block = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(0, len(own), BLOCK):
            a, b = np.nonzero(x[own[k : k + BLOCK]] @ x[to].T >= least)
            v.append(ids[own[k + a]])
            block.append(ids[to[b]])
        return pa.table({"v": np.concatenate(v), "block": np.concatenate(block)})

    near = stash(one.unionByName(two).groupBy("g", "i", "j").applyInArrow(meet, "v bigint, block bigint"), "near")
    parts = near.groupBy("block").agg(F.ceil(F.count("*") / WIDE).cast("int").alias("parts"))
    columns = ["block", "part", "asked", "v", "x", "w", "c", "dense"]
    asking = near.join(parts, "block").withColumn("part", spread("v", "parts")).join(rows, "v").withColumn("asked", F.lit(False))
    asked = members.join(parts, "block").withColumn("part", every("parts")).withColumn("asked", F.lit(True))

    def run(table: pa.Table) -> pa.Table:
        v, w, c, dense, asked = (table[n].to_numpy() for n in ("v", "w", "c", "dense", "asked"))
        x = _unit(_matrix(table["x"].combine_chunks()))
        one, two = np.flatnonzero(asked), np.flatnonzero(~asked)
        linked = x[one] @ x[two].T >= threshold
        linked &= v[one][:, None] != v[two][None]
        rest = ~dense[two].astype(bool)
        p, q = np.nonzero(linked & (c[one][:, None] != c[two][None]))
        join = np.unique(np.stack([c[one[p]], c[two[q]]], 1), axis=0)
        ids = np.concatenate([v[one], v[two[rest]]])
        n = np.concatenate([linked @ w[two], linked.T[rest] @ w[one]]).astype(np.int64)
        none = pa.nulls(len(ids), pa.int64())
        counts = pa.table({"v": ids, "n": n, "a": none, "b": none}).filter(pa.array(n > 0))
        none = pa.nulls(len(join), pa.int64())
        return pa.concat_tables([counts, pa.table({"v": none, "n": none, "a": join[:, 0], "b": join[:, 1]})])

    met = asked.select(columns).unionByName(asking.select(columns)).groupBy("block", "part")
    out = stash(met.applyInArrow(run, "v bigint, n bigint, a bigint, b bigint"), "dense")
    for x in (rows, members, centres, near):
        drop_stash(x)
    return out


def audit(vertices: DataFrame, degrees: DataFrame, threshold: float, queries: int, linked: int = 200, most: int = 64_000) -> tuple[float, int, int]:
    """Mean over audited vertices with links of the share of their links that degrees (v, n) has, the number of these
    vertices, and of all audited ones. Vertices are drawn by a fixed hash, queries at first, and compared with all rows,
    until linked of them have links or, with fewer, most of them (or all that there are) were drawn."""
    total = vertices.count()
    slots = max(1, -(-total // queries))
    drawn = vertices.withColumn("slot", F.pmod(F.xxhash64("v", F.lit(3)), F.lit(slots)))
    first, width, shares, asked = 0, 1, 0.0, 0
    seen = 0
    while first < slots and seen < linked and asked < most:
        chosen = drawn.where((F.col("slot") >= first) & (F.col("slot") < first + width)).select("v", "g", "x", "w").toPandas()
        first, width = first + width, min(4 * width, max(1, 8000 // queries))
        asked += len(chosen)
        if len(chosen):
            true = true_links(vertices, chosen, threshold)
            true = true.join(degrees.select("v", F.col("n").alias("f")), "v", "left")
            have = F.least("n", F.coalesce("f", F.lit(0))) / F.col("n")
            share, more = true.agg(F.sum(have), F.count("*")).first()
            shares, seen = shares + (share or 0.0), seen + more
    return shares / seen if seen else 1.0, seen, asked


def true_links(vertices: DataFrame, chosen: pd.DataFrame, threshold: float) -> DataFrame:
    """(v, n): weight of the rows that each chosen vertex links with, of all rows; those without links aren't returned."""
    by_group = {g: (p["v"].to_numpy(), _unit(np.stack(p["x"].to_numpy()).astype(np.float64))) for g, p in chosen.groupby("g")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, v, w = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("g", "v", "w"))
            for group in set(g.tolist()) & by_group.keys():
                at = np.flatnonzero(g == group)
                q, y = by_group[group]
                x = _unit(_matrix(batch.column(batch.schema.get_field_index("x")).take(pa.array(at))))
                for i in range(0, len(q), BLOCK):
                    own = q[i : i + BLOCK]
                    linked = (y[i : i + BLOCK] @ x.T >= threshold) & (own[:, None] != v[at][None])
                    n = linked @ w[at]
                    yield pa.RecordBatch.from_arrays([pa.array(own[n > 0]), pa.array(n[n > 0])], ["v", "n"])

    true = vertices.select("v", "g", "x", "w").mapInArrow(run, "v bigint, n bigint")
    return true.groupBy("v").agg(F.sum("n").alias("n"))


def near_vectors(
    rows: DataFrame,
    threshold: float = 0.98,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    k: int = 8,
    trees: int = 10,
    recall: float = 0.995,
    queries: int = 500,
    tries: int = 3,
) -> DataFrame:
    """(key, n_links, component_id, kept) of each row."""
    usable = valid(F.col(vector)) & F.col(label).isNotNull() & F.col(key).isNotNull()
    own = rows.select(
        F.col(key).cast("bigint").alias("id"),
        F.when(usable, F.xxhash64(label, F.size(vector))).alias("g"),
        F.when(usable, F.xxhash64(label, vector)).alias("v"),
        F.when(usable, F.xxhash64(F.lit("second"), vector, label)).alias("v2"),
        F.when(usable, F.col(vector)).alias("x"),
    )
    vertices = own.where("v is not null").groupBy("v", "g").agg(F.first("x").alias("x"), F.count("*").alias("w"), F.min("id").alias("id"), F.min("v2").alias("low"), F.max("v2").alias("high"))
    alike = F.when(F.col("low") == F.col("high"), F.col("v")).otherwise(F.raise_error(F.lit("two vectors share a hash")).cast("bigint"))
    vertices = stash(vertices.select(alike.alias("v"), "g", "x", "w", "id"), "vectors")
    dims = [r[0] for r in vertices.select(F.size("x").alias("d")).distinct().collect()]
    edges: DataFrame | None = None
    for attempt in range(tries + 1):
        if attempt == tries:  # the search doesn't reach the recall here: every row is compared
            labels = stash(vertices.select("v", F.col("v").alias("component"), F.lit(True).alias("dense")), "labels")
            dense = dense_counts(vertices, labels, threshold)
            degrees = dense.where("v is not null").select("v", "n").groupBy("v").agg(F.sum("n").alias("n"))
            labels = components(dense.where("a is not null"), "a", "b").withColumnsRenamed({"id": "v", "component_id": "component"})
            break
        for dim in dims:  # vectors of one length are the usual case
            some = vertices.where(F.size("x") == dim)
            new = projected(some, range(trees * (2**attempt - 1), trees * (2 ** (attempt + 1) - 1)), dim).withColumn("fresh", F.lit(1))
            edges = new if edges is None else edges.unionByName(new)
        if edges is None:
            edges = vertices.sparkSession.createDataFrame([], EDGE + ", fresh int")
        lists = stash(best_lists(edges, k), "lists")
        before = -1
        for r in count():
            links = lists.where(F.col("s") >= threshold).count()
            if links <= before * 1.002:
                break
            before = links
            found = None
            for dim in dims:
                part = descend(lists, vertices.where(F.size("x") == dim), k, r)
                found = part if found is None else found.unionByName(part)
            if found is None:
                break
            new = best_lists(lists.withColumn("fresh", F.lit(0)).unionByName(found.withColumn("fresh", F.lit(1))), k)
            new = stash(new, "lists")
            drop_stash(lists)
            lists = new
        graph = lists.where(F.col("s") >= threshold).select("v", "u")
        full = graph.groupBy("v").agg(F.count("*").alias("m")).where(F.col("m") >= k).select("v")
        labels = components(graph, "v", "u").withColumnsRenamed({"id": "v", "component_id": "component"})
        crowded = labels.join(full, "v", "left_semi").select("component").distinct().withColumn("dense", F.lit(True))
        labels = stash(labels.join(crowded, "component", "left").select("v", "component", F.coalesce("dense", F.lit(False)).alias("dense")), "labels")
        dense = dense_counts(vertices, labels, threshold)
        both = graph.select("v", "u").unionByName(graph.select(F.col("u").alias("v"), F.col("v").alias("u"))).distinct()
        both = both.join(labels.where("dense"), "v", "left_anti")
        outside = both.join(vertices.select(F.col("v").alias("u"), "w"), "u").groupBy("v").agg(F.sum("w").alias("n"))
        inside = dense.where("v is not null").select("v", "n")
        degrees = stash(inside.unionByName(outside).groupBy("v").agg(F.sum("n").alias("n")), "degrees")
        joined = dense.where("a is not null").select("a", "b")
        if not joined.isEmpty():
            joined = joined.unionByName(labels.select(F.col("v").alias("a"), F.col("component").alias("b")))
            labels = components(joined).withColumnsRenamed({"id": "v", "component_id": "component"})
        share, seen, asked = audit(vertices, degrees, threshold, queries)
        logger.info("attempt %d: mean recall %.4f of %d linked vertices among %d audited", attempt, share, seen, asked)
        if share >= recall:
            break
        edges = lists
    smallest = labels.join(vertices.select("v", "id"), "v").groupBy("component").agg(F.min("id").alias("low"))
    found = vertices.select("v", "w", "id").join(labels, "v", "left").join(smallest, "component", "left").join(degrees, "v", "left")
    found = stash(found.select("v", F.coalesce("low", "id").alias("low"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n")), "vectors-found")
    drop_stash(vertices, degrees, labels, dense)
    out = own.select("id", "v").join(found, "v", "left")
    component = F.coalesce("low", "id")
    return out.select(
        F.col("id").alias(key),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )
