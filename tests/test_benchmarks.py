"""Swapped facts, answers as words, claims with evidence, and the output cache."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from tessella.operators import benchmarks
from tessella.sources import loaders, store
from tessella.sources.stash import new_path

ARTICLE = [
    ("The tower was finished in 1889 by the company of Eiffel. It is 330 metres high and stands in Paris by the river.", ["1889", "Eiffel", "330"]),
    ("Seven million people visit the tower each year, more than 1889 others in the town of Lyon do together.", ["Seven million", "Lyon"]),
    ("Its paint weighs 60 tonnes and is renewed every 7 years by about 25 painters with brushes.", ["60", "7", "25"]),
    ("Gustave lived in a small flat at the top, where Edison was once a guest of his in the year 1889 as well.", ["Edison", "1889"]),
]


def questions(spark):
    rows = [("Tower", p, q, f"{p}-{q}", context, a) for p, (context, answers) in enumerate(ARTICLE) for q, a in enumerate(answers)]
    rows.append(("Alone", 0, 0, "x", "Only one name, Berlin, is in this article of a single paragraph.", "Berlin"))
    return spark.createDataFrame(rows, "title string, paragraph_no int, question_no int, id string, context string, answer string")


def test_swapped_facts_equal_the_plain_choice(spark):
    answers = [a for _, own in ARTICLE for a in own]
    number = lambda a: any(c.isdigit() for c in a)
    want = {}
    for p, (context, own) in enumerate(ARTICLE):
        for q, a in enumerate(own):
            pool = [x for x in answers if x != a and number(x) == number(a) and x not in context and len(x) < 40]
            if pool:
                want[f"{p}-{q}"] = pool[(p * 7 + q * 13) % len(pool)]
    found = {r.id: r for r in benchmarks.swap_pairs(questions(spark)).collect()}
    assert len(want) >= 9 and set(found) == set(want)
    for i, other in want.items():
        p, q = map(int, i.split("-"))
        a = ARTICLE[p][1][q]
        assert a in found[i].sentence and found[i].swapped == found[i].sentence.replace(a, other, 1), i
        assert found[i].kind == ("number" if number(a) else "name")


def test_answers_as_words(spark):
    rows = spark.createDataFrame([("The Éiffel-Tower, a tower!",), ("  ",), (None,)], "a string")
    assert [r.t for r in rows.select(benchmarks.answer_tokens(F.col("a")).alias("t")).collect()] == [["eiffel", "tower", "tower"], [], []]
    predicted = spark.createDataFrame([(1, "in the year 1889"), (2, ""), (3, "nothing")], "query_id int, answer string")
    golds = spark.createDataFrame([(1, 0, "1889"), (1, 1, "year 1889"), (2, 0, "the"), (3, 0, "Paris")], "query_id int, gold_no int, answer string")
    assert {r.query_id: r.f1 for r in benchmarks.answer_f1(predicted, golds).collect()} == {1: 0.8, 2: 1.0, 3: 0.0}


def test_claims_with_evidence(spark, tmp_path):
    claims = [{"id": 1, "claim": "Iron rusts.", "evidence": {"7": [{"sentences": [0, 2], "label": "SUPPORT"}, {"sentences": [1], "label": "CONTRADICT"}]}}, {"id": 2, "claim": "None.", "evidence": {}}]
    corpus = [{"doc_id": 7, "title": "Rust", "abstract": ["Wet iron rusts.", "Gold never does.", "So keep it dry."]}]
    for name, rows in (("claims", claims), ("corpus", corpus)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    found = sorted(tuple(r) for r in loaders.read_claims(spark, os.fspath(tmp_path / "claims.jsonl"), os.fspath(tmp_path / "corpus.jsonl")).collect())
    whole = "Wet iron rusts. Gold never does. So keep it dry."
    assert found == [("1:7:0-2", "Iron rusts.", "SUPPORT", "Rust", whole, "Wet iron rusts. So keep it dry."), ("1:7:1", "Iron rusts.", "CONTRADICT", "Rust", whole, "Gold never does.")]


def test_benchmark_files(spark, tmp_path):
    (tmp_path / "qrels.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t2\nq1\td2\t0\n")
    assert [tuple(r) for r in loaders.read_qrels(spark, os.fspath(tmp_path / "qrels.tsv"), "test").collect()] == [("test", "q1", "d1", 2), ("test", "q1", "d2", 0)]
    (tmp_path / "corpus.jsonl").write_text('{"_id": "d1", "title": "T", "text": "body"}\n{"_id": "d2", "text": "x"}\n')
    assert [tuple(r) for r in loaders.read_corpus(spark, os.fspath(tmp_path / "corpus.jsonl")).collect()] == [("d1", "T", "body"), ("d2", None, "x")]
    nested = {"data": [{"title": "T", "paragraphs": [{"context": "c0", "qas": [{"id": "a", "question": "q?", "answers": [{"text": "x"}, {"text": "x"}, {"text": "y"}]}]}, {"context": "c1", "qas": []}]}]}
    (tmp_path / "squad.json").write_text(json.dumps(nested))
    assert [tuple(r) for r in loaders.squad_questions(spark, os.fspath(tmp_path / "squad.json")).collect()] == [("T", 0, "c0", "a", "q?", ["x", "y"])]
    ring = spark.createDataFrame([("T", 0, "a"), ("T", 1, "b"), ("T", 2, "c")], "title string, n int, text string")
    assert {r.text: r.other for r in loaders.near_misses(ring, "title", "n", "text").collect()} == {"a": "b", "b": "c", "c": "a"}


def test_output_cache(spark):
    path, seen = new_path(spark, "cache"), []
    rows = lambda *texts: spark.createDataFrame([(t,) for t in texts], "t string")

    def compute(missing):
        seen.append(sorted(r.t for r in missing.collect()))
        return missing.select("key", F.length("t").alias("output"))

    def outputs(model, *texts):
        probes = spark.createDataFrame([(0, [model, 1.0]), (1, [2.0])], "probe_no int, output array<double>")
        name = store.namespace_of(spark, path, probes)
        return name, sorted(r.output for r in store.cached_outputs(spark, path, rows(*texts), "t", name, compute).collect())

    assert outputs(0.5, "a", "bb", "a", None) == ("ns0001", [1, 2])
    assert outputs(0.5003, "a", "bb") == ("ns0001", [1, 2])  # near enough: nothing is computed
    assert outputs(0.5, "bb", "ccc") == ("ns0001", [2, 3])
    assert outputs(0.9, "a") == ("ns0002", [1])  # another model
    assert outputs(0.5) == ("ns0001", [])
    assert seen == [["a", "bb"], ["ccc"], ["a"]]
