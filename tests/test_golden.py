"""Golden cases of functions and operators that have no SQL twin."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tessella.functions import citations as C
from tessella.functions import text as T
from tessella.functions.citations import FALLBACK
from tessella.operators import answer, evaluate, ingest, report, retrieve
from tessella.sources import loaders, store
from tessella.sources.stash import new_path

SOURCE = "query_id int, rank int, doc_id string, doc_name string, idx int, page int, text string, tokens int, score double, neighbor boolean"


def values(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict(recursive=True)


def sources(spark, *rows):
    return spark.createDataFrame([(q, r, d, n, p, p, t, 30, 1.0 / r, False) for q, r, d, n, p, t in rows], SOURCE)


def test_small_functions(spark):
    text = F.lit
    found = values(
        spark,
        contents=T.toc_like(text("One ........ 3\nTwo ........ 9\nThree ........ 14")),
        prose=T.toc_like(text("One sentence of words.")),
        embed=T.embedding_text(text("Doc"), text("Alpha"), text("body")),
        embed_bare=T.embedding_text(text(""), text(""), text("body")),
        short=T.short_name(text(" [Annual] Report of the whole large company 2024 v2.final.pdf")),
        sizes=F.array(*(T.format_bytes(text(n)) for n in (0, 1023, 1536, 5 * 2**20, 3 * 2**30))),
        middle=T.nearest_rank(F.array(*map(text, (5.0, 1.0, 3.0))), 50),
        score=F.array(C.parse_score(text("Score: 4\nJustification: fine")), C.parse_score(text("I say 3 of 5")), C.parse_score(text("nothing"))),
        why=C.parse_justification(text("Score: 2\nJustification: too short")),
        judged=C.parse_judge(text('```json\n{"groundedness": 4, "relevance": 5, "context_relevance": 3, "unsupported_claims": ["x", " "], "justification": "fine"}\n```')),
        loose=C.parse_judge(text("groundedness: 2, relevance: 3")),
        pages=C.cited_pages(text("x [p. 2402, 2403] y [Guide p. 7]")),
        expected=C.parse_expected(text("3, 7")),
        none=F.size(C.parse_expected(text("soon"))),
    )
    assert found["contents"] and not found["prose"]
    assert (found["embed"], found["embed_bare"]) == ("Doc › Alpha\nbody", "body")
    assert found["short"] == "Annual Report of the whole large company"
    assert found["sizes"] == ["0 B", "1023 B", "1.5 KB", "5.0 MB", "3.00 GB"] and found["middle"] == 3.0
    assert found["score"] == [4, 3, None] and found["why"] == "too short"
    assert found["judged"] == {"groundedness": 4, "relevance": 5, "context_relevance": 3, "unsupported": ["x"], "missing": [], "justification": "fine"}
    assert (found["loose"]["groundedness"], found["loose"]["relevance"], found["loose"]["context_relevance"]) == (2, 3, None)
    assert found["pages"] == [7, 2402, 2403] and [(c["name"], c["page"]) for c in found["expected"]] == [("", 3), ("", 7)] and found["none"] == 0


FACTS = "Heat 30 grams of the powder within the first 3 minutes. Sodium is the preferred catalyst. Filters do not improve the yield in this setup."
NAMES = "Strains with KLM1 grow at a higher rate. Dorsin acts as a switch in beetles. TGR21 lowers XREP-2 levels in 12 of 14 plants."
CLAIMS = [
    (FACTS, "Heat 30 grams of the powder within the first 3 minutes", "supported", [], None),
    (FACTS, "Heat 30 grams of the powder within the first 6 minutes", "partial", ["6"], None),
    (FACTS, "The preferred catalyst is Potassium", None, ["potassium"], None),
    (FACTS, "Filters improve the yield in this setup", "partial", [], "negation"),
    (NAMES, "KLM 1 strains grow at a higher rate", None, [], None),
    (NAMES, "Dorsin1 acts as a switch in beetles", None, [], None),
    (NAMES, "TGR21 lowers XREP2 levels in 12 of 14 plants", "supported", [], None),
    (NAMES, "TGR21 lowers XREP2 levels in 12 of 16 plants", "partial", ["16"], None),
    (NAMES, "TGR21 lowers PQRS9 levels in 12 of 14 plants", None, ["pqrs9"], None),
    (NAMES, "Drinking herbal tea dissolves the gold ring quickly", "unsupported", None, None),
]


def test_claim_support(spark):
    held = sources(spark, *[(i, 1, "m", "Paper", 2, text) for i, (text, *_) in enumerate(CLAIMS)])
    answers = spark.createDataFrame([(i, f"{claim} [Paper p. 2]") for i, (_, claim, *_) in enumerate(CLAIMS)], "query_id int, answer string")
    rows = {r.query_id: r for r in evaluate.claim_support(answers, held).collect()}
    for i, (_, claim, status, missing, conflict) in enumerate(CLAIMS):
        assert status is None or rows[i].status == status, (claim, rows[i])
        assert missing is None or rows[i].missing == missing, (claim, rows[i])
        assert rows[i].conflict == conflict and "[" not in rows[i].plain, (claim, rows[i])


def test_wrong_passages_and_citations(spark):
    held = sources(spark, (1, 1, "m", "Handbook", 3, "The usual repair is a full change of the pump seal, done with open or guided tools."), (1, 2, "g", "Guide", 6, "Mixed search joins keyword and vector rankings by reciprocal rank fusion."))
    said = "- Mixed search joins keyword and vector rankings by reciprocal rank fusion [Handbook p. 3]\n- change of the pump seal [Handbook p. 3]\n- fusion of the rankings [Handbook p. 6]"
    answers = spark.createDataFrame([(1, said)], "query_id int, answer string")
    first = min(evaluate.claim_support(answers, held).collect(), key=lambda r: r.claim_no)
    assert first.status == "supported" and first.misattributed and first.cited_ratio < 0.3
    c = evaluate.citation_check(answers, held).first()
    assert (c.cited, c.valid, c.invalid, c.precision, c.coverage) == (2, 1, 1, 0.5, 1.0)  # page 6 is the Guide's
    s = evaluate.support_summary(evaluate.claim_support(answers, held)).first()
    assert s.misattributed == 1 and s.claims == 3


def test_extractive_answers(spark):
    text = "Cold welds are common in the vacuum of a chamber and cold welds need close checks by the crew. Graphite is the first-choice lubricant when a weld keeps coming back in the chamber. Other remarks follow here without much to say about it."
    origin = "The Northern Society of Great Bridges was founded in Leeds in the year 1799 by leading builders. It was established by Henry Carver and Joseph Barnes to spread knowledge of arches. Many members met there each week for dinner and talk."
    held = sources(spark, (1, 1, "m", "Handbook", 2, text), (2, 1, "h", "History", 1, origin), (3, 1, "h", "History", 1, origin))
    asked = spark.createDataFrame([(1, "Which lubricant is first-choice for cold welds?"), (2, "Who established the Northern Society of Great Bridges?"), (3, "zebra xylophone")], "query_id int, question string")
    idf = spark.createDataFrame([("cold", 0.4), ("welds", 0.4), ("lubricant", 3.5), ("firstchoice", 2.5), ("first", 1.0), ("choice", 1.0)], "term string, idf double")
    by = {r.query_id: r for r in answer.extractive_answer(held, asked, idf).collect()}
    assert [x for x in by[1].answer.split("\n") if x.startswith("- ")][0].startswith("- Graphite")
    plain = {r.query_id: r for r in answer.extractive_answer(held, asked).collect()}
    bullets = [x for x in plain[2].answer.split("\n") if x.startswith("- ")]
    assert "founded in Leeds" in bullets[0] and "It was established by Henry Carver" in bullets[0] and sum("Henry Carver" in b for b in bullets) == 1
    assert by[3].answer == FALLBACK and by[3].bullets == 0


def test_compaction_and_context(spark):
    parts = [f"Sentence number {w} says something about a garden and its plants today." for w in ("one", "two", "three", "four", "five", "six")]
    parts[3] = "The turbine blade cracked after a long season of heavy storms at sea."
    held = sources(spark, (1, 1, "d", "Doc", 1, " ".join(parts))).withColumn("tokens", T.estimate_tokens(F.col("text")))
    asked = spark.createDataFrame([(1, "Why did the turbine blade crack?")], "query_id int, question string")
    r = answer.compact_context(held, asked, share=0.2, least=10).first()
    assert r.compacted and r.text == " ".join(parts[3:5])
    context = retrieve.format_context(held.withColumns({"neighbor_of": F.lit(None).cast("int"), "section": F.lit("Blades")})).first()
    assert context.context.startswith("[Doc p. 1] (section: Blades)\nSentence number one") and context.context_tokens == held.first().tokens


def test_diverse_choice(spark):
    rows = [(1, "d", 0, 1.0, [1.0, 0.0]), (1, "d", 1, 0.95, [1.0, 0.05]), (1, "d", 2, 0.6, [0.0, 1.0]), (1, "d", 3, 0.5, None)]
    few = spark.createDataFrame(rows, "query_id int, doc_id string, idx int, score double, vector array<double>")
    order = lambda d: [r.idx for r in sorted(retrieve.mmr(few, 3, d).collect(), key=lambda r: r.rank)]
    assert order(0.5) == [0, 2, 3] and order(1.0) == [0, 1, 2]


def test_chunking(spark):
    same = "A paragraph that stands on two pages of the same document without any change."
    pages = [("a", 1, "## Alpha topic\nText of the first page about alpha that is long enough to be a chunk."), ("a", 2, "It goes on about alpha on the next page with enough words to count."), ("b", 1, same), ("b", 2, same), ("c", 1, "gardens " * 900)]
    chunks = ingest.chunk_pages(spark.createDataFrame(pages, "doc_id string, page int, text string"), size=120, overlap=20)
    rows = sorted(chunks.collect(), key=lambda r: (r.doc_id, r.pos))
    assert [(r.page, r.section, r.idx) for r in rows if r.doc_id == "a"] == [(1, "Alpha topic", 0), (2, "Alpha topic", 1)]
    assert [r.idx for r in rows if r.doc_id == "b"] == [0, None]
    long = [r for r in rows if r.doc_id == "c"]
    assert len(long) > 5 and max(r.tokens for r in long) <= 140
    stats = {r.doc_id: r for r in ingest.describe_chunks(chunks).collect()}
    assert (stats["b"].chunks, stats["b"].dropped, stats["a"].sections) == (1, 1, 1)


def test_pagination(spark):
    text = "\n\n".join(f"Paragraph {i} " + "word " * 30 for i in range(40))
    pages = ingest.paginate(spark.createDataFrame([(1, text), (2, "one\ftwo")], "doc_id int, text string"), 1000).collect()
    own = [p for p in pages if p.doc_id == 1]
    assert len(own) > 3 and all(len(p.text) <= 1300 for p in own) and [p.page for p in own] == list(range(1, len(own) + 1))
    assert [(p.page, p.text) for p in pages if p.doc_id == 2] == [(1, "one"), (2, "two")]


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title\n\n![pic](x.png)See [the site](http://x) now.\n\n##### Deep\n```py\ncode\n```\n")
    (tmp_path / "b.xyz").write_text("?")
    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Some </w:t></w:r><w:r><w:t>text</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>item</w:t></w:r></w:p>'
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{word}"><w:body>{body}</w:body></w:document>')
    (tmp_path / "c.docx").write_bytes(packed.getvalue())
    known, unknown = loaders.read_files(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r.kind for r in known.collect()} == {"a.md": "text", "c.docx": "docx"} and unknown.count() == 1
    text = known.where("kind = 'text'").select(loaders.markdown_text(F.decode("content", "utf-8")).alias("t"))
    shown = text.select("t", loaders.title_of(F.col("t")).alias("title")).first()
    assert shown.title == "Title" and "See the site now." in shown.t and "png" not in shown.t and "#####" not in shown.t and "```" not in shown.t
    assert loaders.docx_pages(known.where("kind = 'docx'"), "path", "content").first().text == "\n## Head\n\nSome text\n\n- item"
    lines = spark.createDataFrame([("p", 1, 0, "A large heading", 18.0), ("p", 1, 1, "A body line of more than twenty letters", 12.0), ("p", 1, 2, "Another body line of the same height here", 12.0)], "doc_id string, page int, line_no int, text string, height double")
    assert loaders.pdf_lines_to_pages(lines).first().text.split("\n")[0] == "## A large heading"


def test_stored_tables(spark):
    docs = spark.createDataFrame([("a", "A", "text", "m", 2), ("b", "B", "pdf", "m", 1)], "doc_id string, name string, kind string, embed_model string, embed_done int")
    chunks = spark.createDataFrame([("a", 0, 1, "s", "x", 1), ("a", 1, 1, "s", "y", 1), ("b", 0, 1, "", "z", 1)], "doc_id string, idx int, page int, section string, text string, tokens int")
    vectors = spark.createDataFrame([("a", 0, "m", [1, -2], 0.5), ("a", 1, "old", [3, 4], 0.5), ("b", 0, "m", [-128, 127], 0.25), ("b", 1, "m", [0, 0], 1.0)], "doc_id string, idx int, model string, q array<tinyint>, scale float")
    assert sorted((r.doc_id, r.idx) for r in store.load_vectors(vectors, docs).collect()) == [("a", 0), ("b", 0)]
    path = new_path(spark, "pack")
    store.export_pack(docs, chunks, vectors.where("model = 'm' and idx = 0"), path)
    d, c, v = store.import_pack(spark, path)
    assert sorted(r.name for r in d.collect()) == ["A", "B"] and c.count() == 3 and sorted(map(tuple, (r.q for r in v.collect()))) == [(-128, 127), (1, -2)]
    tables = {n: new_path(spark, n) for n in ("d", "c")}
    docs.write.parquet(tables["d"])
    chunks.write.parquet(tables["c"])
    store.delete_documents(spark, tables, docs.where("doc_id = 'a'"))
    assert [spark.read.parquet(p).count() for p in tables.values()] == [1, 1]
    members = store.add_members(spark.createDataFrame([("k", "a")], "collection_id string, doc_id string"), spark.createDataFrame([("k", "a"), ("k", "c")], "collection_id string, doc_id string"))
    assert members.count() == 2 and store.of_collection(chunks, members, "k").count() == 2
    runs = spark.createDataFrame([("q", "p", [("a", 0, "x")])], "question string, prompt string, sources array<struct<doc_id: string, idx: int, text: string>>")
    small = store.slim(runs)
    assert "prompt" not in small.columns and small.selectExpr("inline(sources)").columns == ["doc_id", "idx"]
    back = store.hydrate(small.selectExpr("inline(sources)"), chunks).first()
    assert back.text == "x"
    talk = spark.createDataFrame([("s", 2, "q2", None), ("s", 1, "q1", "a1")], "session_id string, turn int, question string, answer string")
    assert store.session_markdown(talk).first().markdown == "## q1\n\na1\n\n## q2\n\n"
    out = new_path(spark, "lab")
    store.lab_csv(spark.createDataFrame([('say "x"', 1, None)], "a string, b int, c string"), out)
    assert [r.value for r in spark.read.text(out).collect() if "say" in r.value] == ['"say ""x""","1",""']


def test_reports(spark):
    moving = spark.createDataFrame([(50, 200, 10.0), (0, 10, 0.0)], "done int, total int, seconds double")
    assert [(r.rate, r.remaining) for r in report.embedding_progress(moving).collect()] == [(5.0, 30.0), (None, None)]
    change = spark.createDataFrame([(10, 0.2, 0.0006, 0.4), (10, 0.2, 0.0004, 0.4)], "n int, mean_change double, low double, high double")
    assert [r.better for r in report.better(change).collect()] == [True, False]


@pytest.mark.parametrize("with_sources", [True, False])
def test_clicked_citations(spark, with_sources):
    held = sources(spark, (1, 1, "m", "Handbook", 3, "x"), (1, 2, "g", "Guide", 6, "y")).where(str(with_sources).lower())
    cites = spark.createDataFrame([(1, "Guide", 6), (1, "Nothing", 9), (1, "Manual", 1)], "query_id int, name string, page int")
    docs = spark.createDataFrame([("z", "Handbook", 0), ("g", "Guide", 1), ("n", "Manual of arms", 2)], "doc_id string, doc_name string, pos int")
    found = {r.name: r.doc_id for r in report.resolve_citations(cites, held, docs).collect()}
    assert found == {"Guide": "g", "Nothing": "m" if with_sources else "z", "Manual": "n"}
