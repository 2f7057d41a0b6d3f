"""Registered queries of whole question runs, corrective retries and the dashboard, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import ask, index, retrieve
from tessella.operators.rows import with_texts
from tessella.plans import sql
from tessella.plans.queries import PAGED, TERMS, _bm25, _bm25_sql, _cosine_sql, _rrf, _rrf_sql, documents, paged_chunks, placed, query, questions, row_texts, stored_index, table, vector_queries
from tessella.sources.stash import stash


def library(spark, sf_dir) -> ask.Library:
    """The documents table as a library: a vector belongs to the chunk of its id; a question's vector is that of its id."""
    found = stored_index(spark, sf_dir)
    chunks = paged_chunks(spark, sf_dir)

    def keyword(asked, k):
        return placed(index.bm25_search(found, index.query_terms(asked), k, False), chunks)

    def semantic(asked, k):
        docs = documents(spark, sf_dir).select(F.col("source").alias("doc_id"), F.col("doc_id").alias("idx"))
        rows = docs.join(table(spark, sf_dir, "embeddings"), F.col("idx") == F.col("vec_id"))
        vectors = rows.select("doc_id", "idx", F.lit("m").alias("model"), F.col("embedding").alias("vector"))
        own = vector_queries(spark, sf_dir).drop("question").join(asked.select("query_id"), "query_id", "left_semi")
        return placed(retrieve.cosine_candidates(vectors, own, k), chunks)

    texts = lambda rows: with_texts(rows, row_texts(spark, sf_dir), ["row_id"]).drop("row_id")
    return ask.Library(chunks, texts, keyword, semantic, idf=index.collection_idf(found, index.query_terms(questions(spark, sf_dir))))


def _run(spark, sf_dir) -> ask.Run:
    config = ask.RunConfig(retrieve.RetrievalConfig(neighbors=True, context_budget=6000))
    return ask.run_questions(library(spark, sf_dir), questions(spark, sf_dir), config)


@query()
def run_questions(spark, sf_dir):
    """Every question from the search to the confidence; weak answers are tried again."""
    return _run(spark, sf_dir).records


@query(f"""
WITH k AS ({_bm25_sql(False, 10)}), s AS (SELECT query_id, doc_id, idx, score, rank FROM ({_cosine_sql(10).replace("v.label AS doc_id, v.vec_id AS idx", "d.source AS doc_id, d.doc_id AS idx").replace("CROSS JOIN embeddings v", "CROSS JOIN embeddings v JOIN dd d ON d.doc_id = v.vec_id")})),
f AS ({_rrf_sql((1.0, 1.0))}),
a AS (SELECT 'bm25' AS stage, query_id, doc_id, idx, rank FROM k UNION ALL SELECT 'semantic', query_id, doc_id, idx, rank FROM s UNION ALL SELECT 'fused', query_id, doc_id, idx, rank FROM f)
SELECT a.stage, a.query_id, a.rank, a.doc_id, c.idx FROM a JOIN ({PAGED}) c ON c.doc_id = a.doc_id AND c.row_id = a.idx""")
def run_trace(spark, sf_dir):
    """The first ten of each list of the first attempt, by the chunks' places."""
    config = ask.RunConfig(retrieve.RetrievalConfig(), retrieval_only=True)
    trace = ask.run_questions(library(spark, sf_dir), questions(spark, sf_dir), config).trace
    return trace.where("stage <> 'sources'").select("stage", "query_id", "rank", "doc_id", "idx")


@query(f"""
WITH q AS (SELECT DISTINCT item_id AS query_id, term FROM ({sql.term_rows('benchmark', 'item_id', 'text')})),
t AS (SELECT DISTINCT source, doc_id, term FROM ({TERMS})), n AS (SELECT query_id, COUNT(*) AS n FROM q GROUP BY query_id),
s1 AS (SELECT query_id, doc_id AS source, idx FROM ({_bm25_sql(False, 1)})), s2 AS (SELECT query_id, doc_id AS source, idx FROM ({_rrf_sql((1.0, 1.0), 3)})),
h1 AS (SELECT q.query_id, COUNT(DISTINCT q.term) AS h FROM q JOIN s1 USING (query_id) JOIN t ON t.source = s1.source AND t.doc_id = s1.idx AND t.term = q.term GROUP BY q.query_id),
h2 AS (SELECT q.query_id, COUNT(DISTINCT q.term) AS h FROM q JOIN s2 USING (query_id) JOIN t ON t.source = s2.source AND t.doc_id = s2.idx AND t.term = q.term GROUP BY q.query_id),
c AS (SELECT b.item_id AS query_id, ROUND(COALESCE(h1.h, 0) / n.n::DOUBLE, 6) AS a, ROUND(COALESCE(h2.h, 0) / n.n::DOUBLE, 6) AS b FROM benchmark b JOIN n ON n.query_id = b.item_id
  LEFT JOIN h1 ON h1.query_id = b.item_id LEFT JOIN h2 ON h2.query_id = b.item_id),
d AS (SELECT *, a = 0 OR a < 0.75 AS weak, 1 + 4 * a - CASE WHEN a = 0 THEN 2 ELSE 0 END AS qa, 1 + 4 * b - CASE WHEN b = 0 THEN 2 ELSE 0 END AS qb FROM c)
SELECT query_id, CASE WHEN weak THEN 2 ELSE 1 END::INTEGER AS attempts, CASE WHEN weak AND qb >= qa THEN 2 ELSE 1 END::INTEGER AS attempt, CASE WHEN weak AND qb >= qa THEN b ELSE a END AS covered FROM d""")
def corrective_retry(spark, sf_dir):
    """A question's own words in its best chunk as the first attempt; where less than three quarters are there, three
    chunks of both lists are tried, and the better attempt stays."""
    asked = questions(spark, sf_dir)
    words = stash(asked.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("question")))).alias("term")), "words")

    def answered(lists):
        chosen = lists.select("query_id", F.col("idx").alias("row_id"))
        held = with_texts(chosen, row_texts(spark, sf_dir), ["row_id"]).select("query_id", F.explode(T.tokens(F.col("text"))).alias("term")).distinct()
        share = words.join(held.withColumn("h", F.lit(1)), ["query_id", "term"], "left").groupBy("query_id").agg(F.round(F.sum(F.coalesce("h", F.lit(0))) / F.count("*"), 6).alias("covered"))
        rows = share.withColumns({"fallback": F.col("covered") == 0, "groundedness": F.lit(None).cast("int"), "score": 1 + 4 * F.col("covered")})
        # needs_correction tests a half: shares are stretched so that three quarters stand at it
        return rows.withColumns({"share": F.col("covered") / 1.5, "quality": ask.quality()})

    keyword = stash(_bm25(spark, sf_dir, False, 20), "keyword")  # both attempts come of one search
    first = stash(answered(keyword.where("rank = 1")), "first")

    def again(weak):
        lists = _rrf(spark, sf_dir, (1.0, 1.0), keyword).where("rank <= 3")
        return answered(lists.join(weak, "query_id", "left_semi")).join(weak, "query_id", "left_semi")

    return ask.corrective_retry(first, again).select("query_id", "attempts", "attempt", "covered")


@query("""
WITH e AS (SELECT *, (props->>'$.k')::INTEGER AS k FROM events),
r AS (SELECT user_id, event_type <> 'error' AS done, value AS ms, CASE WHEN event_type = 'view' THEN k % 5 + 1 END AS g, CASE WHEN event_type = 'click' THEN k END AS s,
  CASE WHEN k >= 80 THEN 'High' WHEN k >= 60 THEN 'Medium' ELSE 'Low' END AS level, CASE event_type WHEN 'purchase' THEN 'up' WHEN 'error' THEN 'down' END AS f, k > 95 AS cut, k FROM e),
p AS (SELECT user_id, ms, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ms) AS i, COUNT(*) OVER (PARTITION BY user_id) AS n FROM r WHERE done),
q AS (SELECT user_id, MAX(CASE WHEN i = LEAST(n, n * 50 // 100 + 1) THEN ms END) AS p50, MAX(CASE WHEN i = LEAST(n, n * 95 // 100 + 1) THEN ms END) AS p95 FROM p GROUP BY user_id),
a AS (SELECT user_id, COUNT(*) FILTER (WHERE done) AS answers, COUNT(*) FILTER (WHERE done AND cut) AS truncated, ROUND(AVG(g) FILTER (WHERE done), 6) AS groundedness,
  ROUND(AVG(s / 100.0::DOUBLE * 100) FILTER (WHERE done), 6) AS support, COUNT(*) FILTER (WHERE done AND level = 'High') AS high, COUNT(*) FILTER (WHERE done AND level = 'Medium') AS medium,
  COUNT(*) FILTER (WHERE done AND level = 'Low') AS low, COUNT(*) FILTER (WHERE f = 'up') AS up, COUNT(*) FILTER (WHERE f = 'down') AS down,
  AVG(k) FILTER (WHERE done) AS t1, AVG(100 - k) FILTER (WHERE done) AS t2, COUNT(*) FILTER (WHERE done) AS n FROM r GROUP BY user_id)
SELECT user_id AS session_id, answers, truncated, groundedness, support, high, medium, low, up, down, ROUND(t1 / 100, 6) AS search_share, ROUND(t2 / 100, 6) AS generation_share, p50, p95
FROM a JOIN q USING (user_id) WHERE n > 0""")
def quality_dashboard(spark, sf_dir):
    """A user's events as a session: errors aren't finished, a purchase is a vote for and an error one against; k of the
    properties gives groundedness (views), support (clicks), the level and the times of two steps."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    records = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        F.when(kind == "error", "error").otherwise("done").alias("phase"),
        F.col("value").alias("total_ms"),
        (k > 95).alias("truncated"),
        F.when(kind == "view", k % 5 + 1).alias("groundedness"),
        F.when(kind == "click", 1).otherwise(0).alias("claims"),
        (k / 100.0).alias("share"),
        F.when(k >= 80, "High").when(k >= 60, "Medium").otherwise("Low").alias("level"),
        F.when(kind == "purchase", "up").when(kind == "error", "down").alias("feedback"),
        k.cast("double").alias("search"),
        (100 - k).cast("double").alias("generation"),
    )
    return ask.session_dashboard(records, ["search", "generation"])
