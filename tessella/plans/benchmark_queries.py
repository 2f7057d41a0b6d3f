"""Registered queries of benchmark material and cached model outputs, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators import benchmarks
from tessella.operators.rows import with_texts
from tessella.plans.queries import _bm25, _bm25_sql, documents, query, questions, row_texts, table
from tessella.sources import loaders, store
from tessella.sources.stash import new_path

@query(f"""
WITH d AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS paragraph_no FROM dd WHERE text IS NOT NULL),
a AS (SELECT source AS title, paragraph_no, 0 AS question_no, doc_id, text, regexp_extract(text, '[0-9]+') AS answer FROM d UNION ALL
  SELECT source, paragraph_no, 1, doc_id, text, regexp_extract(text, '[A-Za-z]{{8,}}') FROM d),
b AS (SELECT *, regexp_matches(answer, '[0-9]') AS number FROM a WHERE answer <> ''),
l AS (SELECT title, number, list(answer ORDER BY paragraph_no, question_no) AS answers FROM b WHERE length(answer) < 40 GROUP BY title, number),
p AS (SELECT b.*, list_filter(l.answers, lambda x: x <> b.answer AND NOT contains(b.text, x)) AS pool FROM b JOIN l USING (title, number))
SELECT doc_id || '/' || question_no AS id, CASE WHEN number THEN 'number' ELSE 'name' END AS kind, answer, pool[(paragraph_no * 7 + question_no * 13) % len(pool) + 1] AS other FROM p WHERE len(pool) > 0""")
def swap_pool(spark, sf_dir):
    """Of each document its first number and its first long word as answers; another answer of its source for each."""
    docs = documents(spark, sf_dir).where("text IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    answers = F.array(*(F.struct(F.lit(n).alias("question_no"), F.regexp_extract("text", p, 0).alias("answer")) for n, p in enumerate(("[0-9]+", "[A-Za-z]{8,}"))))
    docs = docs.select(F.col("source").alias("title"), place.alias("paragraph_no"), "doc_id", "text")
    rows = docs.select("title", "paragraph_no", "doc_id", F.col("text").alias("context"), F.inline(answers)).where("answer <> ''")
    rows = rows.withColumn("id", F.concat_ws("/", F.col("doc_id").cast("string"), F.col("question_no").cast("string")))
    return benchmarks.swap_picks(rows).select("id", "kind", "answer", "other")


@query("""
WITH b AS (SELECT item_id, text, unnest([item_id * 2, item_id * 2 + 1]) AS doc_id FROM benchmark),
s AS (SELECT b.item_id, b.text AS claim, b.doc_id, unnest([[0], [1, 0]]) AS sentences, unnest(['SUPPORT', 'CONTRADICT']) AS label FROM b),
d AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL)
SELECT s.item_id || ':' || s.doc_id || ':' || array_to_string(sentences, '-') AS id, claim, label, d.source AS title, COALESCE(array_to_string(d.lines, ' '), '') AS abstract,
  COALESCE(array_to_string(list_filter(list_transform(sentences, lambda i: d.lines[i + 1]), lambda x: x IS NOT NULL), ' '), '') AS evidence
FROM s LEFT JOIN d USING (doc_id)""")
def claims_corpus(spark, sf_dir):
    """Benchmark items as claims with evidence in two documents each, written as JSON lines and read again."""
    claims, corpus = (new_path(spark, x) for x in ("claims", "claims-corpus"))
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("title"), F.split("text", "\n").alias("abstract")).write.json(corpus)
    pieces = F.array(F.struct(F.array(F.lit(0)).alias("sentences"), F.lit("SUPPORT").alias("label")), F.struct(F.array(F.lit(1), F.lit(0)).alias("sentences"), F.lit("CONTRADICT").alias("label")))
    items = table(spark, sf_dir, "benchmark")
    evidence = F.create_map((F.col("item_id") * 2).cast("string"), pieces, (F.col("item_id") * 2 + 1).cast("string"), pieces)
    items.select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("claim"), evidence.alias("evidence")).write.json(claims)
    return loaders.read_claims(spark, claims, corpus)


def _words_sql(x: str) -> str:
    return f"list_filter(string_split(trim(regexp_replace(strip_accents(lower({x})), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w NOT IN ('', 'a', 'an', 'the'))"


@query(f"""
WITH p AS (SELECT b.query_id, {_words_sql('d.text')} AS t FROM ({_bm25_sql(False, 1)}) b JOIN documents d ON d.doc_id = b.idx),
g AS (SELECT item_id AS query_id, 0 AS gold_no, {_words_sql('text')} AS t FROM benchmark UNION ALL SELECT item_id, 1, {_words_sql("left(text, 200)")} FROM benchmark),
pw AS (SELECT query_id, w, COUNT(*) AS n FROM (SELECT query_id, unnest(t) AS w FROM p) GROUP BY ALL), gw AS (SELECT query_id, gold_no, w, COUNT(*) AS m FROM (SELECT query_id, gold_no, unnest(t) AS w FROM g) GROUP BY ALL),
c AS (SELECT query_id, gold_no, SUM(LEAST(n, m)) AS c FROM gw JOIN pw USING (query_id, w) GROUP BY ALL)
SELECT g.query_id, ROUND(MAX(CASE WHEN len(g.t) = 0 OR len(p.t) = 0 THEN (len(g.t) = len(p.t))::INTEGER::DOUBLE ELSE 2 * COALESCE(c.c, 0) / (len(g.t) + len(p.t))::DOUBLE END), 6) AS f1
FROM g JOIN p USING (query_id) LEFT JOIN c ON c.query_id = g.query_id AND c.gold_no = g.gold_no GROUP BY g.query_id""")
def answer_f1(spark, sf_dir):
    """The best chunk against two golds: the question and its beginning."""
    best = _bm25(spark, sf_dir, False, 1).select("query_id", F.col("idx").alias("row_id"))
    predicted = with_texts(best, row_texts(spark, sf_dir), ["row_id"]).select("query_id", F.col("text").alias("answer"))
    golds = questions(spark, sf_dir).select("query_id", F.posexplode(F.array("question", F.substring("question", 1, 200))).alias("gold_no", "answer"))
    return benchmarks.answer_f1(predicted, golds)


@query("SELECT sha1(text) AS key, strlen(text)::DOUBLE AS output, COUNT(*) AS rows FROM documents WHERE text IS NOT NULL GROUP BY text")
def cached_outputs(spark, sf_dir):
    """Outputs of a model (the length in bytes) for all texts, in two runs: the second one computes the other half only."""
    path = new_path(spark, "outputs")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    compute = lambda rows: rows.select("key", F.octet_length("text").cast("double").alias("output"))
    probes = spark.range(3).select(F.col("id").alias("probe_no"), F.array(F.col("id").cast("double")).alias("output"))
    store.cached_outputs(spark, path, docs.where("doc_id % 2 = 0"), "text", store.namespace_of(spark, path, probes), compute)
    found = store.cached_outputs(spark, path, docs, "text", store.namespace_of(spark, path, probes), compute)
    rows = docs.where("text IS NOT NULL").groupBy(F.sha1("text").alias("key")).agg(F.count("*").alias("rows"))
    return rows.join(found, "key")
