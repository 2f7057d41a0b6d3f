"""Registered queries against their DuckDB twins, and golden cases of the functions without one."""

from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from tessella.functions import citations as C
from tessella.functions import text as T
from tessella.functions.porter import stem
from tessella.operators import index, retrieve
from tessella.plans import ask_queries, benchmark_queries, evaluation_queries, library_queries, queries, report_queries  # noqa: F401  all fill the registry
from tessella.streaming import embed
from tests.compare import TESTDATA, difference

SF = f"{TESTDATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    assert difference(spark, name, queries.QUERIES[name], queries.ORACLES[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_stemmer():
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "relational": "relat", "conditional": "condit", "adjustment": "adjust", "probate": "probat", "rate": "rate", "controll": "control", "is": "is"}
    assert {w: stem(w) for w in pairs} == pairs


def test_citations(spark):
    text = F.lit("A claim [Doc A p. 3; Doc B p. 10-12] and [PDF p. 5, 7] but not [page nine].")
    found = [(c["name"], c["page"]) for c in value(spark, C.parse_citations(text))]
    assert found == [("Doc A", 3), ("Doc B", 10), ("Doc B", 11), ("Doc B", 12), ("", 5), ("", 7)]
    assert value(spark, C.cited_pages(text)) == [3, 5, 7, 10, 11, 12]


def test_judge_score(spark):
    assert [value(spark, C.parse_score(F.lit(x))) for x in ("Score: 4", "**Score** - 2 of 5", "I give it a 3.", "none")] == [4, 2, 3, None]


def test_estimate_tokens(spark):
    assert [value(spark, T.estimate_tokens(F.lit(x))) for x in ("", "one two three four", "a" * 40)] == [0, 5, 10]


def test_hash(spark):
    assert value(spark, T.fnv1a(F.lit("hello"))) == 1335831723


def test_fusion(spark):
    """The key that both lists hold wins."""
    schema = "query_id int, doc_id string, idx int, score double, rank int"
    one = spark.createDataFrame([(1, "d", 1, 9.0, 1), (1, "d", 2, 8.0, 2)], schema)
    two = spark.createDataFrame([(1, "d", 2, 0.9, 1), (1, "d", 3, 0.8, 2)], schema)
    fused = {r.idx: r.score for r in retrieve.fuse([one, two], [1.0, 1.0]).collect()}
    assert max(fused, key=fused.get) == 2 and abs(fused[2] - (1 / 62 + 1 / 61)) < 1e-12


def test_folding(spark):
    """Every character of the basic plane that has a decomposition, against the standard library."""
    chars = [c for c in map(chr, [*range(0x80, 0xD800), *range(0xF900, 0x10000)]) if unicodedata.decomposition(c) or "̀" <= c <= "ͯ" or "가" <= c <= "힣"]
    rows = spark.createDataFrame([(c, f"a{c}b") for c in chars], "c string, x string")
    for r in rows.select("c", T.unmarked(F.col("x")).alias("y")).collect():
        want = "".join(x for x in unicodedata.normalize("NFKD", r.c) if not "̀" <= x <= "ͯ")
        assert r.y == f"a{want}b", (r.c, r.y)


def test_names_and_numbers(spark):
    claim = F.lit("In Paris, Émile used IL-6 and NASA data. Tesla's first car; the Mercedes-Benz cost 1,000 and BRCA1 2.5")
    assert value(spark, C.names_of(claim)) == ["paris", "emile", "nasa", "mercedes", "benz", "brca1"]
    assert value(spark, C.numbers_of(claim)) == ["6", "1000", "1", "2.5"]
    assert value(spark, C.numbers_of(F.lit("CD4 has 12 cells"), True)) == ["12"]
    assert {"srebp2", "srebp", "brca1", "brca"} <= set(value(spark, C.name_words(F.lit("SREBP-2 and BRCA1"))))


def test_index_reads_no_text(spark, tmp_path):
    """A built index is searched without its texts."""
    rows = spark.createDataFrame([("d", 0, "alpha beta beta"), ("d", 1, "Gamma; the-end"), ("e", 0, None)], "doc_id string, idx int, text string")
    index.build(rows, str(tmp_path / "index"), F.col("text"))
    found = index.open_index(spark, str(tmp_path / "index"))
    assert {(r.doc_id, r.idx, r.dl) for r in found.lengths.collect()} == {("d", 0, 3), ("d", 1, 3), ("e", 0, 0)}
    asked = spark.createDataFrame([(1, "beta")], "query_id int, term string")
    hits = index.bm25_search(found, asked, 10, False)
    assert [(r.doc_id, r.idx) for r in hits.collect()] == [("d", 0)]
    assert "text" not in hits._jdf.queryExecution().optimizedPlan().toString()


def test_retrieval_with_neighbours(spark):
    """Two chunks are chosen; of their neighbours those fit that the budget allows, next before previous."""
    rows = [("d", i, i // 3 + 1, "s", f"text {i}", 10) for i in range(6)]
    chunks = spark.createDataFrame(rows, "doc_id string, idx int, page int, section string, text string, tokens int")
    keyword = spark.createDataFrame([(1, "d", 1, 2.0, 1), (1, "d", 4, 1.0, 2)], "query_id int, doc_id string, idx int, score double, rank int")
    config = retrieve.RetrievalConfig(mode="bm25", k=2, neighbors=True, context_budget=45)
    got = {(r.idx, r.neighbor, r.neighbor_of) for r in retrieve.retrieve(chunks, keyword, config).collect()}
    assert got == {(1, False, None), (4, False, None), (2, True, 1), (0, True, 1)}


def test_embed_stream(spark, tmp_path):
    """A start without new files does nothing; a key that comes again takes its latest vector; nulls are rows, too."""
    schema = "doc_id string, idx int, text string"
    paths = [str(tmp_path / x) for x in ("chunks", "vectors", "checkpoint")]
    embed_text = lambda x: F.array(F.coalesce(F.length(x), F.lit(0)), F.lit(1))
    parts = [[("d", 0, "four"), ("d", 0, "four"), ("d", 1, None)], [], [("d", 0, "12345678"), ("e", 0, "")]]
    for part in parts:
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(paths[0])
        embed.embed_stream(spark, *paths, schema, embed_text, "m")
    found = {(r.doc_id, r.idx): (r.q, round(r.scale * 127, 4)) for r in embed.vectors_of(spark, paths[1]).collect()}
    assert found == {("d", 0): ([127, 16], 8.0), ("d", 1): ([0, 127], 1.0), ("e", 0): ([0, 127], 1.0)}
