"""Candidate lists and their fusion: cosine search, reciprocal rank fusion, diversity, neighbours, whole retrieval."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import estimate_tokens, source_label
from tessella.operators.index import KEYS, top
from tessella.operators.vector_search import cosine_candidates  # noqa: F401  a list of retrieval

RRF_K = 60


@dataclass(frozen=True)
class RetrievalConfig:
    mode: str = "hybrid"
    k: int = 4
    fetch_k: int = 20
    diversity: float = 0.5
    neighbors: bool = False
    context_budget: int = 1800
    weights: tuple[float, float] = (1.0, 1.0)
    rrf_k: int = RRF_K
    rerank: bool = False

    @property
    def pool(self) -> int:
        return max(self.fetch_k, 4 * self.k)


def fuse(lists: list[DataFrame], weights: list[float] | None = None, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: (query_id, doc_id, idx, score) with score = sum of weight / (k + rank)."""
    weights = weights or [1.0] * len(lists)
    parts = [x.select("query_id", *KEYS, (F.lit(float(w)) / (k + F.col("rank"))).alias("part")) for x, w in zip(lists, weights)]
    return reduce(DataFrame.unionByName, parts).groupBy("query_id", *KEYS).agg(F.sum("part").alias("score"))


def vectors_ready(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(doc_id, ready): a document is ready when each of its chunks has a vector."""
    have = vectors.groupBy("doc_id").agg(F.count("*").alias("v"))
    need = chunks.groupBy("doc_id").agg(F.count("*").alias("c"))
    return need.join(have, "doc_id", "left").select("doc_id", (F.coalesce("v", F.lit(0)) >= F.col("c")).alias("ready"))


def effective_mode(mode: str, ready: Column, documents: Column) -> Column:
    """What a requested mode becomes when only some documents have vectors."""
    partial = F.lit("hybrid (partial)" if mode == "hybrid" else f"{mode} + bm25")
    return F.when((ready == 0) | F.lit(mode == "bm25"), "bm25").when(ready < documents, partial).otherwise(mode)


def mmr(candidates: DataFrame, k: int, diversity: float = 0.5, similarity: Callable | None = None) -> DataFrame:
    """Greedy maximal marginal relevance over each query's few candidates (query_id, doc_id, idx, score, vector).

    A step takes the candidate with the largest diversity * score - (1 - diversity) * (its largest similarity to one
    taken before, at least 0); missing vectors have similarity 0. Candidates are at most fetch_k a query.
    """
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}

    def cosine(a, b) -> float:
        if a is None or b is None or len(a) != len(b):
            return 0.0
        a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
        norm = np.linalg.norm(a) * np.linalg.norm(b)
        return float(a @ b / (norm or 1))

    alike = similarity or cosine

    def pick(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (-r["score"], r["doc_id"], r["idx"]))
        overlap, taken = [0.0] * len(rows), []
        left = list(range(len(rows)))
        while left and len(taken) < k:
            best = max(left, key=lambda i: (diversity * rows[i]["score"] - (1 - diversity) * overlap[i], -i))
            left.remove(best)
            taken.append(rows[best])
            for i in left:
                overlap[i] = max(overlap[i], alike(rows[i]["vector"], rows[best]["vector"]))
        out = {n: [r[n] for r in taken] for n in ("query_id", *KEYS, "score")}
        return pa.table(out | {"rank": pa.array(range(1, len(taken) + 1), pa.int32())}, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = ", ".join(f"{n} {kinds[n]}" for n in ("query_id", *KEYS, "score")) + ", rank int"
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return candidates.select("query_id", *KEYS, "score", "vector").groupBy("query_id").applyInArrow(pick, schema)


def neighbor_candidates(chosen: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks next to chosen ones (query_id, doc_id, idx, rank): same document and section, pages at most one apart, not
    chosen themselves; a chunk that several name belongs to the first of them. An equi join on the two offsets."""
    base = chosen.select("query_id", *KEYS, F.col("rank").alias("neighbor_of"))
    own = chunks.select(*KEYS, F.col("section").alias("s0"), F.col("page").alias("p0"))
    sides = base.join(own, list(KEYS)).withColumn("step", F.explode(F.array(F.lit(1), F.lit(-1))))
    sides = sides.withColumn("idx", F.col("idx") + F.col("step"))
    found = sides.join(chunks.select(*KEYS, "section", "page", "tokens"), list(KEYS))
    found = found.where((F.col("section") == F.col("s0")) & (F.abs(F.col("page") - F.col("p0")) <= 1))
    found = found.join(base.select("query_id", *KEYS), ["query_id", *KEYS], "left_anti")
    first = Window.partitionBy("query_id", *KEYS).orderBy("neighbor_of", F.desc("step"))
    found = found.withColumn("r", F.row_number().over(first)).where("r = 1")
    return found.select("query_id", *KEYS, "neighbor_of", "step", "tokens")


def within_budget(candidates: DataFrame, used: DataFrame, budget: int) -> DataFrame:
    """Neighbours in rank order, next before previous, each taken if it still fits (a few rows a query)."""
    rows = candidates.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("neighbor_of", (-F.col("step")).alias("o"), *KEYS, "tokens"))).alias("c"))
    rows = rows.join(used, "query_id")
    zero = F.struct(F.col("used").cast("bigint").alias("used"), F.filter("c", lambda x: F.lit(False)).alias("kept"))

    def take(a: Column, x: Column) -> Column:
        fits = a["used"] + x["tokens"] <= budget
        return F.struct(
            F.when(fits, a["used"] + x["tokens"]).otherwise(a["used"]).cast("bigint").alias("used"),
            F.when(fits, F.concat(a["kept"], F.array(x))).otherwise(a["kept"]).alias("kept"),
        )

    kept = F.aggregate("c", zero, take, lambda a: a["kept"])
    return rows.select("query_id", F.explode(kept).alias("x")).select("query_id", "x.doc_id", "x.idx", "x.neighbor_of")


def fused_list(keyword: DataFrame, semantic: DataFrame | None, config: RetrievalConfig, vectors: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, idx, score): one list of the two ranked ones (query_id, doc_id, idx, score, rank), by the mode."""
    if semantic is None or config.mode == "bm25":
        return keyword.select("query_id", *KEYS, "score")
    if config.mode not in ("semantic", "mmr"):
        return fuse([semantic, keyword], list(config.weights), config.rrf_k)
    without = keyword.join(semantic.select("doc_id").distinct(), "doc_id", "left_anti")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *KEYS)
    without = without.withColumn("rank", F.row_number().over(order))
    mixed = fuse([semantic, without])
    partial = without.select("query_id").distinct().withColumn("mixed", F.lit(True))
    alone = semantic.join(partial, "query_id", "left_anti").select("query_id", *KEYS, "score")
    fused = mixed.join(partial, "query_id", "left_semi").unionByName(alone)
    if config.mode == "mmr" and vectors is not None:
        few = top(fused, config.fetch_k).drop("rank").join(vectors.select(*KEYS, "vector"), list(KEYS), "left")
        picked = mmr(few, 2 * config.k, config.diversity)
        fused = picked.select("query_id", *KEYS, (-F.col("rank")).cast("double").alias("score"))
    return fused


def choose(ranked: DataFrame, chunks: DataFrame, config: RetrievalConfig, reranked: DataFrame | None = None) -> DataFrame:
    """The sources of a ranked list: k rows, after a model's scores (query_id, doc_id, idx, rerank_score) where there are any,
    whose order is fused with the list's; then neighbours within the budget. chunks' columns join last."""
    if config.rerank and reranked is not None:
        first = ranked.where(F.col("rank") <= max(config.k, config.fetch_k)).select("query_id", *KEYS, "score", "rank")
        scores = first.join(reranked, ["query_id", *KEYS]).select("query_id", *KEYS, F.col("rerank_score").alias("score"))
        ranked = top(fuse([top(scores, config.fetch_k), first]), config.fetch_k)
    chosen = ranked.where(F.col("rank") <= config.k).select("query_id", *KEYS, "rank", "score")
    sources = chosen.withColumns({"neighbor": F.lit(False), "neighbor_of": F.lit(None).cast("int")})
    if config.neighbors:
        used = chosen.join(chunks.select(*KEYS, "tokens"), list(KEYS)).groupBy("query_id").agg(F.sum("tokens").alias("used"))
        more = within_budget(neighbor_candidates(chosen, chunks), used, config.context_budget)
        more = more.select("query_id", *KEYS, F.lit(None).cast("int").alias("rank"), F.lit(None).cast("double").alias("score"), F.lit(True).alias("neighbor"), "neighbor_of")
        sources = sources.unionByName(more)
    return sources.join(chunks, list(KEYS), "left")


def retrieve(
    chunks: DataFrame,
    keyword: DataFrame,
    config: RetrievalConfig = RetrievalConfig(),
    semantic: DataFrame | None = None,
    vectors: DataFrame | None = None,
    reranked: DataFrame | None = None,
) -> DataFrame:
    """Sources of each query: (query_id, doc_id, idx, rank, neighbor, neighbor_of, score, and the columns of chunks).

    keyword and semantic are ranked lists (query_id, doc_id, idx, score, rank) of config.pool rows."""
    most = max(config.k, config.fetch_k if config.rerank else config.k)
    return choose(top(fused_list(keyword, semantic, config, vectors), most), chunks, config, reranked)


def format_context(sources: DataFrame) -> DataFrame:
    """(query_id, context, context_tokens): sources by their rank, then position, each under its label."""
    section = F.when(F.coalesce("section", F.lit("")) != "", F.concat(F.lit(" (section: "), "section", F.lit(")"))).otherwise("")
    block = F.concat(F.lit("["), source_label(F.col("doc_name"), F.col("page")), F.lit("]"), section, F.lit("\n"), "text")
    rows = sources.select("query_id", F.struct(F.coalesce("neighbor_of", "rank").alias("r"), "idx", block.alias("b")).alias("x"), F.coalesce("tokens", estimate_tokens(F.col("text"))).alias("t"))
    rows = rows.groupBy("query_id").agg(F.sort_array(F.collect_list("x")).alias("x"), F.sum("t").alias("context_tokens"))
    return rows.select("query_id", F.array_join(F.transform("x", lambda x: x["b"]), "\n\n").alias("context"), "context_tokens")
