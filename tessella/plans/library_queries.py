"""Registered queries of libraries that change and of stateful streams, and their SQL twins."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tessella.functions import vectors as V
from tessella.operators import index, upkeep
from tessella.plans.queries import _bm25_sql, chunk_table, query, questions, table
from tessella.sources.catalog import Catalog
from tessella.sources.stash import file_system, new_path
from tessella.streaming import usage

KEPT = "kept AS (SELECT * FROM dd WHERE source NOT IN (SELECT source FROM dd WHERE doc_id % 97 = 0))"


def changed_library(spark, sf_dir) -> Catalog:
    """A library of the documents table: half of its documents are added, then the others; those with a row whose id is
    divisible by 97 are removed."""
    catalog = Catalog(spark, new_path(spark, "library"))
    chunks = chunk_table(spark, sf_dir).withColumns({"text": F.coalesce("text", F.lit("")), "section": F.lit("")})
    first = F.crc32(F.col("doc_id").cast("binary")) % 2 == 0
    for part in (first, ~first):
        own = chunks.where(part)
        docs = own.select("doc_id").distinct().withColumns({"name": F.col("doc_id"), "embed_model": F.lit("m1"), "embed_done": F.lit(0).cast("long")})
        upkeep.add_documents(catalog, docs, own)
    upkeep.remove_documents(catalog, chunks.where("idx % 97 = 0").select("doc_id"))
    return catalog


@query("WITH " + KEPT + ", " + re.sub(r"\bdd\b", "kept", _bm25_sql(True)).replace("FROM documents)", "FROM kept)").strip()[5:])
def index_upkeep(spark, sf_dir):
    """A search after additions, a removal and a merge."""
    catalog = changed_library(spark, sf_dir)
    upkeep.merge_index(catalog)
    found = index.bm25_search(upkeep.open_index(catalog), index.query_terms(questions(spark, sf_dir)), 10, True)
    return found.select("query_id", "doc_id", "idx", F.round("score", 4).alias("score"), "rank")


@query(f"""
WITH {KEPT}, c AS (SELECT source, COUNT(*) AS chunks, COUNT(e.vec_id) AS v, MAX(CASE WHEN doc_id % 53 = 0 THEN 1 ELSE 0 END) AS reset FROM kept LEFT JOIN embeddings e ON e.vec_id = doc_id GROUP BY source)
SELECT source AS doc_id, CASE WHEN reset = 1 THEN 'm2' ELSE 'm1' END AS embed_model, CASE WHEN reset = 1 THEN 0 ELSE v END::BIGINT AS embed_done, chunks, CASE WHEN reset = 1 THEN 0 ELSE v END::BIGINT AS vectors FROM c""")
def library_cascade(spark, sf_dir):
    """What is left of each document in all tables after vectors were added, documents removed and models reset."""
    catalog = changed_library(spark, sf_dir)
    chunks = catalog.table("chunks").select("doc_id", "idx")
    rows = chunks.join(table(spark, sf_dir, "embeddings"), F.col("idx") == F.col("vec_id")).withColumn("z", V.quantize(F.col("embedding")))
    upkeep.add_vectors(catalog, rows.select("doc_id", "idx", F.lit("m1").alias("model"), "z.q", "z.scale"))
    upkeep.reset_model(catalog, chunks.where("idx % 53 = 0"), "m2")
    count = lambda name: catalog.table(name).groupBy("doc_id").agg(F.count("*").alias(name))
    docs = catalog.table("docs").join(count("chunks"), "doc_id", "left").join(count("vectors"), "doc_id", "left")
    return docs.select("doc_id", "embed_model", "embed_done", "chunks", F.coalesce("vectors", F.lit(0)).alias("vectors"))


def _fed(spark, rows, first, stream, name):
    """Rows in two parts, each followed by a start of the stream; gives the folder of its results."""
    source, out, checkpoint = (new_path(spark, f"{name}-{x}") for x in ("source", "out", "checkpoint"))
    for part in (first, ~first):
        rows.where(part).write.mode("append").parquet(source)
        stream(spark, source, out, checkpoint, rows.schema, files=64)
    for done in (source, checkpoint):
        fs, path = file_system(spark, done)
        fs.delete(path, True)
    return out


@query("""
WITH c AS (SELECT strftime(ts, '%Y-%m') AS month, event_type AS purpose, value AS tokens, (props->>'$.k')::INTEGER >= 90 AS failed FROM events)
SELECT month, COALESCE(purpose, '(all)') AS purpose, COUNT(*) FILTER (WHERE NOT failed) AS calls, ROUND(SUM(CASE WHEN failed THEN 0 ELSE tokens END), 4) AS tokens, COUNT(*) FILTER (WHERE failed) AS failures
FROM c GROUP BY GROUPING SETS ((month), (month, purpose))""")
def usage_stream(spark, sf_dir):
    """Events as calls, fed in two starts of the stream."""
    rows = table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("event_type").alias("purpose"), F.col("value").alias("prompt_tokens"), F.lit(0.0).alias("completion_tokens"), (F.get_json_object("props", "$.k").cast("int") >= 90).alias("failed")
    )
    return usage.usage_of(spark, _fed(spark, rows, F.col("event_id") % 3 == 0, usage.usage_stream, "usage"))


@query("""
SELECT user_id AS record_id, event_id AS seq, event_type AS phase FROM (
  SELECT *, LAG(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type""")
def phase_changes(spark, sf_dir):
    """A user's events as updates of a record; the later half arrives after a restart."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("record_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("phase"))
    middle = rows.agg(F.max("seq")).first()[0] // 2

    def stream(*args, **options):
        return usage.phase_stream(*args, **options, final=())

    return usage.changes_of(spark, _fed(spark, rows, F.col("seq") <= middle, stream, "phases"))
