"""Registered queries of listings, meters and reports, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import vectors as V
from tessella.operators import ingest, report
from tessella.plans.evaluation_queries import SOURCES2
from tessella.plans.queries import documents, headed_pages, paged_sources, query, questions, table


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 50")
def newest_events(spark, sf_dir):
    """A top-k listing: the 50 newest calls."""
    return report.newest_first(events(spark, sf_dir), "ts", "event_id", 50).select("event_id", "user_id", "ts")


@query("SELECT event_id, event_id % 4 = 0 AS has_feedback FROM events WHERE event_id % 3 > 0")
def finished_records(spark, sf_dir):
    e = F.col("event_id")
    rows = events(spark, sf_dir).select("event_id", F.when(e % 3 > 0, "done").otherwise("error").alias("phase"), F.when(e % 4 == 0, "up").alias("feedback"))
    return report.finished(rows).select("event_id", "has_feedback")


@query("""SELECT event_id FROM events WHERE event_id % 2 = 0 AND (event_id % 3 > 0 OR (event_id % 5 > 0 AND event_id % 7 > 0))""")
def runnable_configs(spark, sf_dir):
    e = F.col("event_id")
    rows = events(spark, sf_dir).select("event_id", (e % 2 == 0).alias("selected"), (e % 3 == 0).alias("needs_model"))
    return report.runnable(rows, e % 5 > 0, e % 7 == 0).select("event_id")


CONFIGS = ["bm25", "semantic", "mmr", "hybrid", "hybrid-rerank"]


@query("SELECT c AS config_id, item_id AS query_id FROM benchmark CROSS JOIN (VALUES " + ", ".join(f"('{c}')" for c in CONFIGS) + ") AS t(c)")
def lab_grid(spark, sf_dir):
    return report.lab_grid(questions(spark, sf_dir), CONFIGS).select("config_id", "query_id")


@query("""
WITH s AS (SELECT event_id, event_id % 5 = 0 AS x, CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS j, event_id % 2 = 0 AS hyde, event_id % 7 < 3 AS condense,
  event_id % 11 < 5 AS corrective, event_id % 13 < 6 AS follow_up, event_id % 17 = 0 AS vanilla FROM events),
b AS (SELECT *, 1 + j + (hyde AND NOT vanilla)::INTEGER + (condense AND follow_up)::INTEGER AS b FROM s)
SELECT event_id, CASE WHEN x THEN 0 ELSE b END::INTEGER AS base, CASE WHEN x THEN 0 ELSE b + CASE WHEN corrective AND NOT vanilla THEN 2 + j ELSE 0 END END::INTEGER AS worst FROM b""")
def calls_per_question(spark, sf_dir):
    e = F.col("event_id")
    rows = events(spark, sf_dir).select(
        "event_id",
        F.when(e % 5 == 0, "extractive").otherwise("router").alias("provider"),
        F.get(F.array(F.lit("strict"), F.lit("combined"), F.lit("off")), (e % 3).cast("int")).alias("judge"),
        (e % 2 == 0).alias("hyde"),
        (e % 7 < 3).alias("condense"),
        (e % 11 < 5).alias("corrective"),
        (e % 13 < 6).alias("follow_up"),
        (e % 17 == 0).alias("vanilla"),
    )
    return report.calls_per_question(rows).select("event_id", "base", "worst")


@query("""
WITH d AS (SELECT source AS doc_id, SUM(strlen(COALESCE(text, '')))::BIGINT AS b, COUNT(*) AS n, MIN(doc_id) % 2 = 0 AS f FROM dd GROUP BY source),
r AS (SELECT doc_id, CASE WHEN f THEN b ELSE 0 END AS file, b AS chunks, n * 36 AS vectors, n * 16 AS keywords FROM d)
SELECT doc_id, SUM(file)::BIGINT AS file, SUM(chunks)::BIGINT AS chunks, SUM(vectors)::BIGINT AS vectors, SUM(keywords)::BIGINT AS keywords,
  SUM(file + chunks + vectors + keywords)::BIGINT AS total FROM r GROUP BY GROUPING SETS ((doc_id), ())""")
def document_bytes(spark, sf_dir):
    """Bytes of each document's parts, and of the library."""
    size = F.octet_length(F.coalesce("text", F.lit("")))
    rows = documents(spark, sf_dir).groupBy(F.col("source").alias("doc_id")).agg(F.sum(size).alias("size"), F.count("*").alias("embed_done"), (F.min("doc_id") % 2 == 0).alias("has_file"))
    rows = rows.withColumns({"chunk_bytes": F.col("size"), "dim": F.lit(32), "keyword_bytes": F.col("embed_done") * 16})
    return report.document_bytes(rows)


@query("""
SELECT event_id, ROUND(CASE WHEN event_id % 4 > 0 AND event_id % 100 > 0 AND value * 10 > 50 THEN (event_id % 100) / (value * 10 / 1000) END, 6)::DOUBLE AS tokens_per_sec,
  event_id % 6 = 0 AS truncated, ROUND(LEAST(1.0, (event_id % 6000) / 4096.0::DOUBLE), 6)::DOUBLE AS window_share FROM events""")
def generation_rates(spark, sf_dir):
    e = F.col("event_id")
    rows = events(spark, sf_dir).select(
        "event_id",
        (e % 6000).alias("prompt_tokens"),
        (e % 100).alias("completion_tokens"),
        (F.col("value") * 10).alias("latency_ms"),
        (e % 4 == 0).alias("extractive"),
        F.when(e % 6 == 0, "length").when(e % 6 > 2, "stop").alias("finish"),
    )
    return report.generation_rates(rows, 4096).select("event_id", "tokens_per_sec", "truncated", "window_share")


@query("""
SELECT user_id AS run_id, host, COUNT(*) AS calls, SUM(event_id % 900)::BIGINT AS prompt_tokens, bool_or(host <> 'localhost:1234') AS cloud
FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'localhost:1234' ELSE event_type || '.example.org' END AS host FROM events) GROUP BY user_id, host""")
def data_sent(spark, sf_dir):
    host = F.when(F.col("event_id") % 3 == 0, "localhost:1234").otherwise(F.concat("event_type", F.lit(".example.org")))
    return report.data_sent(events(spark, sf_dir).select(F.col("user_id").alias("run_id"), host.alias("host"), (F.col("event_id") % 900).alias("prompt_tokens")))


@query("SELECT user_id, event_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events) WHERE i % 10 = 0")
def every_tenth(spark, sf_dir):
    return report.every_nth(events(spark, sf_dir), "user_id", ["ts", "event_id"], F.lit(10)).select("user_id", "event_id")


@query(r"""
WITH s AS (SELECT source AS doc_id, doc_id AS pos, trim(string_split(COALESCE(text, ''), chr(10))[1]) AS section FROM dd WHERE doc_id % 5 = 0),
t AS (SELECT doc_id, left(section, 40) AS section, MIN(pos) AS pos FROM s WHERE length(left(section, 40)) BETWEEN 4 AND 69 GROUP BY ALL),
n AS (SELECT *, GREATEST(1, COUNT(*) OVER (PARTITION BY doc_id) // 5) AS step, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY pos, section) - 1 AS i FROM t)
SELECT doc_id, pos, CASE WHEN ends_with(trim(section), '?') THEN trim(section) ELSE 'What does ' || doc_id || ' say about ' || regexp_replace(regexp_replace(section, '(?i)^(step|chapter|section)\s*[0-9]+[:.]?\s*', ''), '[:.]$', '') || '?' END AS question
FROM n WHERE i % step = 0 AND i // step < 5""")
def suggested_questions(spark, sf_dir):
    """Questions from section titles: the first 40 characters of every fifth row's first line."""
    first = F.trim(F.split(F.coalesce("text", F.lit("")), "\n")[0])
    rows = documents(spark, sf_dir).where("doc_id % 5 = 0").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("pos"), F.substring(first, 1, 40).alias("section"))
    return report.suggested_questions(rows)


@query("SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS series FROM events GROUP BY user_id")
def trend_series(spark, sf_dir):
    rows = report.trend(events(spark, sf_dir).select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"], "event_id")
    return rows.select("user_id", F.array_join(F.transform("series", lambda x: x.cast("string")), ",").alias("series"))


@query("""
SELECT event_id, ROUND((SUM(v) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - v) / SUM(v) OVER (PARTITION BY user_id)::DOUBLE, 6)::DOUBLE AS "offset"
FROM (SELECT *, event_id % 50 + 1 AS v FROM events)""")
def timing_waterfall(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "ts", "event_id", (F.col("event_id") % 50 + 1).alias("v"))
    return report.waterfall(rows, "user_id", ["ts", "event_id"], "v").select("event_id", "offset")


@query("""SELECT event_type AS config_id, kind, COUNT(*) AS n, ROUND(AVG(v), 6) AS mean FROM (SELECT event_type, 'k' || event_id % 4 AS kind, event_id % 101 AS v FROM events)
GROUP BY GROUPING SETS ((event_type), (event_type, kind))""")
def suite_averages(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.col("event_type").alias("config_id"), F.concat(F.lit("k"), (F.col("event_id") % 4).cast("string")).alias("kind"), (F.col("event_id") % 101).alias("v"))
    return report.suite_averages(rows, "v")


@query("""WITH b AS (SELECT event_type AS step, AVG(event_id % 97) AS before FROM events WHERE event_id % 2 = 0 GROUP BY event_type), a AS (SELECT event_type AS step, AVG(event_id % 31 + 1) AS after FROM events WHERE event_id % 2 = 1 GROUP BY event_type)
SELECT step, ROUND(before, 6) AS before, ROUND(after, 6) AS after, ROUND(before / after, 6) AS factor FROM b JOIN a USING (step)""")
def speed_rows(spark, sf_dir):
    e, rows = F.col("event_id"), events(spark, sf_dir)
    part = lambda cond, ms: rows.where(cond).select(F.col("event_type").alias("step"), ms.alias("ms"))
    return report.speed_rows(part(e % 2 == 0, e % 97), part(e % 2 == 1, e % 31 + 1))


@query("""
WITH p AS (SELECT 'm' || user_id % 40 AS model, CASE event_id % 3 WHEN 0 THEN 'speed' WHEN 1 THEN 'reading' ELSE 'answers' END AS part, event_id % 977 AS value, event_id % 64 AS memory FROM events)
SELECT model, MAX(value) FILTER (WHERE part = 'speed') AS first_token, MAX(value) FILTER (WHERE part = 'reading') AS reading, MAX(memory) AS memory FROM p GROUP BY model HAVING COUNT(*) FILTER (WHERE part = 'speed') > 0""")
def model_rows(spark, sf_dir):
    e = F.col("event_id")
    part = F.when(e % 3 == 0, "speed").when(e % 3 == 1, "reading").otherwise("answers")
    return report.model_rows(events(spark, sf_dir).select(F.concat(F.lit("m"), (F.col("user_id") % 40).cast("string")).alias("model"), part.alias("part"), (e % 977).alias("value"), (e % 64).alias("memory")))


@query(f"""
WITH s AS ({SOURCES2}), b AS (SELECT query_id, doc_id, page FROM s WHERE rank = 1), n AS (SELECT query_id, COUNT(DISTINCT doc_id) <= 1 AS single FROM s GROUP BY query_id),
c AS (SELECT query_id, doc_id AS name, page FROM b UNION ALL SELECT query_id, doc_id, 900 FROM b UNION ALL SELECT query_id, 'Nowhere', 7000 FROM b),
h AS (SELECT c.query_id, c.name, c.page, MIN_BY(s.doc_id, s.rank) AS hit, COUNT(*) AS hits FROM c JOIN n USING (query_id) JOIN s ON s.query_id = c.query_id AND s.page = c.page
  AND (n.single OR starts_with(regexp_replace(s.doc_id, '[^a-z0-9]+', '', 'g'), regexp_replace(lower(c.name), '[^a-z0-9]+', '', 'g')) OR starts_with(regexp_replace(lower(c.name), '[^a-z0-9]+', '', 'g'), regexp_replace(s.doc_id, '[^a-z0-9]+', '', 'g'))) GROUP BY ALL),
d AS (SELECT DISTINCT source AS d, regexp_replace(lower(source), '[^a-z0-9]+', '', 'g') AS dk FROM dd),
m AS (SELECT c.name, MIN(d) AS by_name FROM (SELECT DISTINCT name FROM c) c JOIN d ON starts_with(dk, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g')) OR starts_with(regexp_replace(lower(name), '[^a-z0-9]+', '', 'g'), dk) GROUP BY c.name)
SELECT c.query_id, c.name, c.page, COALESCE(h.hit, m.by_name, b.doc_id) AS doc_id, COALESCE(h.hits, 0)::BIGINT AS hits
FROM c LEFT JOIN h ON h.query_id = c.query_id AND h.name = c.name AND h.page = c.page LEFT JOIN m ON m.name = c.name JOIN b ON b.query_id = c.query_id""")
def resolve_citations(spark, sf_dir):
    """A right citation, one of a page that wasn't retrieved, and one of an unknown document, of each question."""
    sources = paged_sources(spark, sf_dir)
    best = sources.where("rank = 1")
    some = [("doc_name", F.col("page")), ("doc_name", F.lit(900)), (F.lit("Nowhere"), F.lit(7000))]
    parts = [best.select("query_id", (F.col(n) if isinstance(n, str) else n).alias("name"), p.cast("int").alias("page")) for n, p in some]
    docs = documents(spark, sf_dir).select(F.col("source").alias("doc_id"), F.col("source").alias("doc_name")).distinct()
    return report.resolve_citations(parts[0].unionByName(parts[1]).unionByName(parts[2]), sources, docs)


@query("SELECT vec_id, ROUND(1 / (1 + EXP(-embedding[1]::DOUBLE)), 6) AS probability, ROUND(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS cosine FROM embeddings")
def answer_cosine(spark, sf_dir):
    """Cosine of a vector pair (a vector and its mirror image stand for question and answer) and the sigmoid of a score."""
    x = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.sigmoid(x[0].cast("double")), 6).alias("probability"), F.round(V.cosine(x, F.reverse(x)), 6).alias("cosine"))
