"""Question runs on a small library: stages, the second attempt, models as tables, and the dashboard."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tessella.functions.citations import FALLBACK
from tessella.functions.text import estimate_tokens
from tessella.operators import ask, evaluate, index, retrieve
from tessella.sources.stash import new_path

TEXTS = {
    ("Birds", 0): "Swifts sleep while they fly at great heights. They rarely land outside of the breeding season in summer.",
    ("Birds", 1): "Penguins cannot fly but swim at 30 kilometres an hour. Their wings have become flippers over time.",
    ("Birds", 2): "Owls turn their heads by as much as 270 degrees. Their eyes are fixed within the skull and cannot move.",
    ("Rocks", 0): "Granite cools slowly below the surface of the earth. Its crystals are large and easy to see.",
    ("Rocks", 1): "Basalt cools quickly at the surface of the earth. Its crystals are too small to see without a lens.",
}
QUESTIONS = [(1, "How far do owls turn their heads?"), (2, "Which crystals of granite are large?"), (3, "Who painted the ceiling of the chapel?")]


@pytest.fixture(scope="module")
def library(spark):
    rows = [(d, d, i, i + 1, "s", t) for (d, i), t in TEXTS.items()]
    full = spark.createDataFrame(rows, "doc_id string, doc_name string, idx int, page int, section string, text string")
    chunks = full.withColumn("tokens", estimate_tokens(F.col("text")))
    path = new_path(spark, "ask-index")
    index.build(full, path, F.col("text"))
    found = index.open_index(spark, path)
    texts = lambda rows: rows.join(full.select("doc_id", "idx", "text"), ["doc_id", "idx"], "left")
    return ask.Library(chunks.drop("text"), texts, lambda q, k: index.bm25_search(found, index.query_terms(q), k), idf=index.collection_idf(found))


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(QUESTIONS, "query_id long, question string")


def by_id(rows):
    return {r.query_id: r for r in rows.collect()}


def test_run(spark, library, questions):
    run = ask.run_questions(library, questions, ask.RunConfig(retrieve.RetrievalConfig(mode="bm25", k=1)))
    rows = by_id(run.records)
    assert set(rows) == {1, 2, 3} and all(r.phase == "done" and r.effective_mode == "bm25" for r in rows.values())
    assert "270 degrees" in rows[1].answer and "[Birds p. 3]" in rows[1].answer and rows[1].attempts == 1 and rows[1].level == "High"
    assert (rows[1].cited, rows[1].valid, rows[1].invalid, rows[1].utilization) == (1, 1, 0, 1.0) and rows[1].share == 1.0
    assert rows[3].answer == FALLBACK and rows[3].fallback and rows[3].attempts == 2 and rows[3].level == "Low" and rows[3].confidence == 0
    assert rows[3].reasons == ["No answer was found in the sources."] and rows[3].n_sources == 0
    assert {(r.attempt, r.stage): r.questions for r in run.stages.collect()}[(2, "questions")] == sum(r.attempts == 2 for r in rows.values())
    best = {r.query_id: (r.doc_id, r.idx) for r in run.trace.where("stage = 'bm25' and rank = 1 and attempt = 1").collect()}
    assert best == {1: ("Birds", 2), 2: ("Rocks", 0)}


def test_models(spark, library, questions):
    """A generated answer, a judge that likes wide contexts, a rewritten question and a reranker that turns the order round."""
    seen = {}

    def generate(rows):
        return rows.withColumn("answer", F.concat(F.lit("Said from "), F.length(F.coalesce("context", F.lit(""))).cast("string"), F.lit(" letters [Birds p. 1].")))

    def judge(rows):
        return rows.withColumns({"groundedness": F.when(F.length("context") > 150, 5).otherwise(2), "relevance": F.lit(4), "context_relevance": F.lit(3)})

    def rewrite(rows):
        seen["rewritten"] = sorted(r.query_id for r in rows.collect())
        return rows.withColumn("search", F.when(F.col("query_id") == 3, "granite basalt crystals"))

    def rerank(rows):
        return rows.withColumn("rerank_score", -F.length("text").cast("double"))

    models = ask.Models(generate, judge, rewrite, rerank=rerank)
    config = ask.RunConfig(retrieve.RetrievalConfig(mode="bm25", k=1, fetch_k=4, rerank=True))
    run = ask.run_questions(library, questions, config, models)
    rows = by_id(run.records)
    assert seen["rewritten"] == [1, 2, 3]
    assert all(r.attempts == 2 and r.attempt == 2 and r.k == 3 for r in rows.values())
    assert rows[3].search == "granite basalt crystals" and rows[3].n_sources == 2 and rows[3].groundedness == 5 and rows[3].question == QUESTIONS[2][1]
    assert rows[1].answer.startswith("Said from ") and rows[1].relevance == 4
    assert run.sources.where("attempt = 1").count() == 2


def test_a_worse_second_answer_is_dropped(spark):
    schema = "query_id int, fallback boolean, groundedness int, share double, quality double, answer string"
    first = spark.createDataFrame([(1, False, 3, 0.9, 3.0, "a"), (2, False, None, 0.4, 2.6, "b"), (3, True, None, None, -2.0, "c"), (4, False, 4, 0.9, 4.0, "d"), (5, False, None, None, 0.0, "e"), (6, False, 5, 0.2, 5.0, "f")], schema)
    second = {1: 2.9, 2: 2.6, 3: -1.0, 5: -2.0, 6: 5.5}
    asked = []

    def again(weak):
        asked.extend(sorted(r.query_id for r in weak.collect()))
        return first.join(weak, "query_id", "left_semi").withColumns({"quality": F.element_at(F.create_map(*(F.lit(x) for p in second.items() for x in p)), F.col("query_id")), "answer": F.concat("answer", F.lit("2"))})

    rows = {r.query_id: (r.attempts, r.attempt, r.answer) for r in ask.corrective_retry(first, again).collect()}
    assert asked == [1, 2, 3, 5, 6]
    assert rows == {1: (2, 1, "a"), 2: (2, 2, "b2"), 3: (2, 2, "c2"), 4: (1, 1, "d"), 5: (2, 1, "e"), 6: (2, 2, "f2")}


def test_retrieval_only(spark, library, questions):
    run = ask.run_questions(library, questions, ask.RunConfig(retrieve.RetrievalConfig(k=2, neighbors=True), retrieval_only=True))
    rows = by_id(run.records)
    assert "answer" not in run.records.columns and rows[3].n_sources == 0 and rows[1].n_sources >= 2
    near = [(r.idx, r.neighbor_of) for r in run.sources.where("query_id = 1 and neighbor").collect()]
    assert near and all(n == 1 or n == 2 for _, n in near)


def test_dashboard(spark):
    schema = "session_id string, phase string, total_ms double, truncated boolean, groundedness int, claims int, share double, level string, feedback string, search double, generation double"
    rows = [
        ("a", "done", 100.0, True, 5, 2, 0.5, "High", "up", 10.0, 30.0),
        ("a", "done", 300.0, False, None, 0, 0.0, "Low", None, None, 60.0),
        ("a", "error", 999.0, False, 1, 1, 1.0, None, "down", 5.0, 5.0),
        ("b", "error", 1.0, False, None, None, None, None, "up", None, None),
    ]
    found = {r.session_id: r for r in ask.session_dashboard(spark.createDataFrame(rows, schema), ["search", "generation"]).collect()}
    a = found["a"]
    assert (a.answers, a.truncated, a.groundedness, a.support, a.high, a.medium, a.low, a.up, a.down, a.p50, a.p95) == (2, 1, 5.0, 50.0, 1, 0, 1, 1, 1, 300.0, 300.0)
    assert math.isclose(a.search_share, 0.1) and math.isclose(a.generation_share, 0.9) and set(found) == {"a"}


def test_fallback_reply(spark):
    rows = spark.createDataFrame([(FALLBACK,), ("Well: " + FALLBACK.upper(),), ("The provided document",), (None,)], "a string")
    assert [r.f for r in rows.select(evaluate.is_fallback(F.col("a")).alias("f")).collect()] == [True, True, False, False]
