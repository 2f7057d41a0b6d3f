"""Nearest vectors of a batch of questions: blocks of vectors meet blocks of questions as grouped Spark rows.

Neither side passes through the driver. Rows of a model are dealt to blocks by a hash of their key, so one model's rows
are spread over many tasks; a question block is sent to each vector block of its model and a vector row once for each
question block (a single one up to ``QUESTIONS`` questions). In a task a block pair is one matrix product, and only its k
best rows of each question go on to the ranking.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.index import KEYS, top

#: Vectors and questions of a block pair.
VECTORS, QUESTIONS = 8192, 4096
#: Dimensions whose int8 products are summed exactly in single precision: 127 * 127 * 1024 < 2^24.
EXACT = 1024


def int8_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Dot products of all rows of two int8 matrices as 32-bit integers. Parts of EXACT dimensions go through the
    single-precision matrix product, where each sum is an exact integer."""
    out = np.zeros((len(q), len(x)), np.int32)
    for i in range(0, q.shape[1], EXACT):
        out += (q[:, i : i + EXACT].astype(np.float32) @ x[:, i : i + EXACT].astype(np.float32).T).astype(np.int32)
    return out


def matrix(column: pa.ChunkedArray, places: np.ndarray) -> np.ndarray:
    """The lists at places, all of one length, as rows."""
    return column.take(pa.array(places)).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(places), -1)


def by_length(column: pa.ChunkedArray) -> dict[int, np.ndarray]:
    """Places of the lists of each length; nulls and empty lists have none."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    return {int(d): np.flatnonzero(lengths == d) for d in np.unique(lengths) if d}


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norms == 0, 1, norms)


def _products(kind: str, rows: pa.Table, i: np.ndarray, asked: pa.Table, j: np.ndarray) -> np.ndarray:
    q, x = matrix(asked["_q"], j), matrix(rows["_v"], i)
    if kind == "int8":
        scales = [t["_s"].take(pa.array(p)).to_numpy().astype(np.float64) for t, p in ((asked, j), (rows, i))]
        return int8_products(q, x) * scales[0][:, None] * scales[1]
    return unit(q) @ unit(x).T  # a row's scale falls out of the cosine


def best_of_block(rows: pa.Table, asked: pa.Table, k: int, kind: str) -> pa.Table:
    """The k best rows of a block for each of its questions; ties go to the smaller (doc_id, idx)."""
    found = []
    places = by_length(rows["_v"])
    for d, j in by_length(asked["_q"]).items():
        if d not in places:
            continue
        i = places[d]
        s = np.floor(_products(kind, rows, i, asked, j) * 1e6 + 0.5) / 1e6
        s[~np.isfinite(s)] = -np.inf
        n = min(k, len(i))
        low = -np.partition(-s, n - 1, axis=1)[:, n - 1 : n]
        a, b = np.nonzero((s >= low) & (s > -np.inf))
        at = pa.array(i[b])
        own = pa.table({"_j": j[a], "score": s[a, b], "doc_id": rows["doc_id"].take(at), "idx": rows["idx"].take(at)})
        own = own.take(pc.sort_indices(own, [("_j", "ascending"), ("score", "descending"), ("doc_id", "ascending"), ("idx", "ascending")]))
        group = own["_j"].to_numpy()
        place = np.arange(len(group)) - np.searchsorted(group, group)
        own = own.filter(pa.array(place < k))
        found.append(own.append_column("query_id", asked["query_id"].take(own["_j"])))
    columns = ["query_id", "doc_id", "idx", "score"]
    if not found:
        return pa.table({"query_id": asked["query_id"].slice(0, 0), "doc_id": rows["doc_id"].slice(0, 0), "idx": rows["idx"].slice(0, 0), "score": pa.array([], pa.float64())})
    return pa.concat_tables([t.select(columns) for t in found])


def search(vectors: DataFrame, queries: DataFrame, k: int, kind: str, v: Column, q: Column, scales: tuple[Column, Column] | None = None, per_block: int = VECTORS, per_ask: int = QUESTIONS) -> DataFrame:
    """(query_id, doc_id, idx, score, rank): the k best rows of the question's model for each question."""
    blocks, asks = (max(1, math.ceil(t.count() / n)) for t, n in ((vectors, per_block), (queries, per_ask)))
    vs, qs = scales or (F.lit(1.0), F.lit(1.0))
    place = lambda n, *keys: F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    key = ("_model", "_block", "_ask")
    rows = vectors.where(v.isNotNull()).select(F.col("model").alias("_model"), place(blocks, *KEYS).alias("_block"), every(asks).alias("_ask"), *KEYS, v.alias("_v"), vs.cast("double").alias("_s"))
    asked = queries.where(q.isNotNull()).select(F.col("model").alias("_model"), every(blocks).alias("_block"), place(asks, "query_id").alias("_ask"), "query_id", q.alias("_q"), qs.cast("double").alias("_s"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return best_of_block(left, right, k, kind)

    of = lambda t, name: t.schema[name].dataType.simpleString()
    schema = f"query_id {of(queries, 'query_id')}, doc_id {of(vectors, 'doc_id')}, idx {of(vectors, 'idx')}, score double"
    found = rows.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(run, schema)
    return top(found, k)


def cosine_candidates(vectors: DataFrame, queries: DataFrame, k: int, **options) -> DataFrame:
    """Cosine in double precision of vectors (model, doc_id, idx, vector) and questions (query_id, model, qvec)."""
    return search(vectors, queries, k, "cosine", F.col("vector"), F.col("qvec"), **options)


def quantised_candidates(vectors: DataFrame, queries: DataFrame, k: int, **options) -> DataFrame:
    """Cosine of int8 rows (model, doc_id, idx, q, scale) and questions as they are (query_id, model, qvec)."""
    return search(vectors, queries, k, "cosine", F.col("q"), F.col("qvec"), **options)


def int8_candidates(vectors: DataFrame, queries: DataFrame, k: int, **options) -> DataFrame:
    """Dot products of int8 rows (.., q, scale) and int8 questions (.., q, scale): integer sums, then both scales."""
    return search(vectors, queries, k, "int8", F.col("q"), F.col("q"), (F.col("scale"), F.col("scale")), **options)
