"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, and columns with clashing names."""

from __future__ import annotations

import gzip
import random
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import bpe, chat_format, embedding_dedup, license_scan, near_dedup, packing, quality_classifier, quality_rules, sharding, warc
from tessella.llm.queries import word_bpe
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHES = ("id", "v", "x", "n", "g", "k1", "key", "component_id", "kept", "score", "held_out", "n_words", "m0", "l00", "distance", "size", "shard", "slot", "length", "piece", "ids", "_g", "_rank", "uid", "family")


def prose(n: int, seed: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    long = prose(60_000, 1)
    near = prose(80, 2)
    return [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \t\n\x0b\x0c\r ", "en", "a", 7),
        (4, "one", "en", None, 3),
        (5, "ONE", None, "a", 3),
        (6, near, "en", "a", 9),
        (7, near.upper(), "en", "b", 9),
        (8, near + " extra", "en", "a", 9),
        (9, long, "fr", "a", len(long)),
        (10, long + " more words here", "fr", "a", len(long)),
        (11, "é中\U0001f600 İ Σ it's 12.5 <|endoftext|> x" * 9, "zz", "c", 1),
        (12, "   no-break and em spaces are letters of words here", "zz", "c", 1),
        (13, "a a a a a a a a a a a a a a a a a a a a a a a a", "en", "a", 1),
        (14, near, "en", "a", 9),
        (14, near, "en", "a", 9),
        (None, "a row without an id and with enough words for a shingle", "en", "a", 5),
    ]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({c: F.lit("in") for c in CLASHES})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(one, two):
    return Counter(map(tuple, one)) == Counter(map(tuple, two))


def test_near_duplicates(docs, rows, clashing, empty):
    found = near_dedup.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    want = brute.near_duplicates({r[0]: r[1] for r in rows if r[0] is not None}, 5, 80)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == {(i, *x) for i, x in want.items()}
    assert same(near_dedup.near_duplicates(clashing).collect(), found)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_crowded_region(spark):
    """Hundreds of near copies in one region, and two families of them that don't link."""
    base, draw = prose(300, 5).split(), random.Random(3)
    texts = {}
    for i in range(260):
        words = list(base)
        for _ in range(3):
            words[draw.randrange(300)] = f"w{i}x{draw.random()}"
        texts[i] = " ".join(words)
    for i in range(260, 300):
        words = list(base)
        words[:60] = [f"z{j}" for j in range(60)]
        words[i - 200] = f"y{i}"
        texts[i] = " ".join(words)
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = near_dedup.near_duplicates(table).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute.near_duplicates(texts, 5, 80)


def test_templated_source(spark):
    """Pages of one template, 0.79 alike, crowd every region; pairs of them at 0.808 have little that the rest lacks."""
    shared = " ".join(f"s{j}" for j in range(100))
    pages = [f"{shared} q{i // 2} " + " ".join(f"p{i}x{j}" for j in range(12)) for i in range(600)]
    table = spark.createDataFrame(list(enumerate(pages)), "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(table, k=1, percent=80).collect()}
    assert found == {i: (113, i - i % 2) for i in range(600)}


def test_quality_rules(docs, rows, clashing, empty):
    found = quality_rules.quality_rules(docs)
    assert found.columns[:5] == docs.columns
    found = found.collect()
    assert len(found) == len(rows)
    for r in found:
        have = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert have == brute.statistics(r.text)
        assert r.kept == (not r.base_failed)  # too few rows for an estimate
    again = quality_rules.quality_rules(clashing)
    assert again.select("m0", "l00", "_g").distinct().collect() == [("in", "in", "in")]
    assert same(again.select("doc_id", "n_words", "kept").collect(), [(r.doc_id, r.n_words, r.kept) for r in found])
    assert quality_rules.quality_rules(empty).count() == 0


def test_quality_rules_outliers(spark):
    """Symbol-ridden rows among many ordinary ones are rejected; a share of 20 percent doesn't mask itself."""
    rows = [(i, prose(120, i), "en", "a", 1) for i in range(400)]
    rows += [(1000 + i, prose(60, i) + " #$%&|<>*" * 40, "en", "a", 1) for i in range(100)]
    found = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(found[1000 + i] for i in range(100)) and sum(found[i] for i in range(400)) >= 395


def test_quality_classifier(spark, docs, rows, clashing, empty):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(1, 15)] + [(6, 0, None), (None, 1, None), (99, None, None)], "doc_id long, quality int, toxic int")
    found = quality_classifier.quality_classifier(docs, labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    again = quality_classifier.quality_classifier(clashing, labels)
    assert same(again.select("doc_id", "score").collect(), [(r.doc_id, r.score) for r in found])
    one_class = quality_classifier.quality_classifier(docs, labels.where("quality = 1")).collect()
    assert len({r.score for r in one_class}) == 1
    assert quality_classifier.quality_classifier(docs, labels.where("false")).count() == len(rows)
    assert quality_classifier.quality_classifier(empty, labels).count() == 0


def test_bpe(docs, rows, clashing, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_bpe())
    encoded = bpe.encode(docs, word_bpe()).collect()
    for r in encoded:
        assert r.ids == tokenizer.encode(r.text or "", add_special_tokens=False).ids, r.doc_id
    decoded = bpe.decode(bpe.encode(docs, word_bpe()), word_bpe()).collect()
    assert all(r.decoded == tokenizer.decode(r.ids, skip_special_tokens=False) for r in decoded)
    assert same(bpe.encode_digests(clashing, word_bpe()).collect(), bpe.encode_digests(docs, word_bpe()).collect())
    assert bpe.encode_digests(empty, word_bpe()).count() == 0


def test_bpe_random_unicode():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    tokenizer, own = Tokenizer.from_file(word_bpe()), bpe.load(word_bpe())
    chars = st.characters(blacklist_categories=("Cs", "Cn"))

    @settings(max_examples=300, deadline=None)
    @given(st.text(chars) | st.text("ab'sSrRe lL.1İΣé́ \n", max_size=40))
    def agree(text):
        assert own.encode(text) == tokenizer.encode(text, add_special_tokens=False).ids

    agree()


def test_packing(docs, rows, clashing, empty):
    found = packing.pack(docs, word_bpe()).collect()
    assert Counter(r.doc_id for r in found if r.piece == 0) == Counter(r[0] for r in rows)
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 4096
    assert len(packing.pack(clashing, word_bpe()).collect()) == len(found)
    assert packing.pack(empty, word_bpe()).count() == 0


def test_bin_completion():
    """As few bins as an exhaustive search finds, where best-fit decreasing needs one more."""
    draw = random.Random(1)

    def fewest(items, capacity, bins=()):
        if not items:
            return len(bins)
        best = len(bins) + len(items)
        for i, room in enumerate(bins):
            if room >= items[0] and room not in bins[:i]:
                best = min(best, fewest(items[1:], capacity, (*bins[:i], room - items[0], *bins[i + 1 :])))
        return min(best, fewest(items[1:], capacity, (*bins, capacity - items[0])))

    improved = 0
    for _ in range(150):
        capacity = 30
        items = sorted((draw.randint(4, 18) for _ in range(draw.randint(1, 9))), reverse=True)
        found = packing.bin_completion(Counter(items), capacity)
        plan = found.patterns
        assert found.bins == sum(times for times, _ in plan) >= found.bound
        assert Counter(x for times, own in plan for y, n in own for x in [y] * n * times) == Counter(items)
        assert all(sum(y * n for y, n in own) <= capacity for _, own in plan)
        want = fewest(items, capacity)
        assert sum(times for times, _ in plan) == want, items
        counts = packing.np.bincount(items, minlength=capacity + 1)
        improved += sum(times for times, _ in packing.best_fit(counts, capacity)) > want
    assert improved


def test_sharding(docs, rows, clashing, empty):
    found = sharding.shard(docs, shards=5).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    for s in {r.shard for r in found}:
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))
    assert sharding.shard(clashing, shards=5).count() == len(rows)
    assert sharding.shard(empty).count() == 0


def test_sharding_hot_text(spark):
    """A third of the rows are one text; shards still differ by less than two rows."""
    rows = [(i, "hot text" if i % 3 == 0 else prose(5 + i % 40, i), None, None, None) for i in range(3000)]
    sizes = Counter()
    for r in sharding.shard(spark.createDataFrame(rows, SCHEMA), shards=7).collect():
        sizes[r.shard] += r.size
    assert len(sizes) == 7 and max(sizes.values()) - min(sizes.values()) < 2000


def test_near_vectors(spark):
    draw = random.Random(9)
    one = [draw.gauss(0, 1) for _ in range(16)]
    rows = [(i, [x + draw.gauss(0, 0.02) for x in one], i % 2) for i in range(120)]
    rows += [(200 + i, [draw.gauss(0, 1) for _ in range(16)], 0) for i in range(40)]
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, one, None), (303, [float("nan"), *one[1:]], 0), (304, [None, *one[1:]], 0), (305, [float("inf"), *one[1:]], 0), (306, [], 0), (307, one[:8], 0), (308, one, 1), (309, one, 1), (310, [2 * x for x in one], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = embedding_dedup.near_vectors(table).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == brute.near_vectors(rows, 0.98)
    again = embedding_dedup.near_vectors(table.withColumns({c: F.lit(1) for c in CLASHES}))
    assert same(again.collect(), found)
    assert embedding_dedup.near_vectors(table.where("false")).count() == 0


def test_near_vectors_of_two_families(spark):
    """Lists full of a vertex's own family hide its links with the other one, and with a row of few links."""
    rng = np.random.default_rng(8)
    basis = np.linalg.qr(rng.standard_normal((16, 16)))[0]
    family = lambda c: [c * basis[0] + np.sqrt(1 - c * c) * basis[1] + 0.002 * rng.standard_normal(16) for _ in range(12)]
    vectors = family(1.0) + family(0.985) + [0.984 * basis[0] + np.sqrt(1 - 0.984**2) * basis[2]]
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(vectors)]
    found = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == brute.near_vectors(rows, 0.98)
    assert sum(r.kept for r in found) == 1


def test_audit_counts_vertices(spark):
    """Lost pairs aren't outweighed by a large family, and pairs are looked for until some are seen."""
    rng = np.random.default_rng(9)
    unit = lambda x: x / np.sqrt((x * x).sum(-1, keepdims=True))
    family = unit(unit(rng.standard_normal(32)) + 0.002 * rng.standard_normal((300, 32)))
    ones = unit(rng.standard_normal((40, 32)))
    vectors = np.concatenate([family, ones, unit(ones + 0.01 * rng.standard_normal((40, 32)))])
    vertices = [(i, 1, [float(x) for x in v], 1) for i, v in enumerate(vectors)]
    vertices = spark.createDataFrame(vertices, "v long, g long, x array<double>, w long")
    degrees = spark.createDataFrame([(i, 299) for i in range(300)], "v long, n long")
    share, seen, asked = embedding_dedup.audit(vertices, degrees, 0.98, 500)
    assert (seen, asked) == (380, 380) and abs(share - 300 / 380) < 1e-9
    rare = vertices.where("v >= 300 and v <= 340").unionByName(spark.createDataFrame([(1000 + i, 1, [float(x) for x in v], 1) for i, v in enumerate(unit(rng.standard_normal((900, 32))))], vertices.schema))
    assert embedding_dedup.audit(rare, degrees, 0.98, 100)[:2] == (0.0, 2)


def test_near_vectors_isolated_pairs(spark):
    """Pairs just above the threshold in one label; a search of too little effort is gone on with, then completed."""
    rng = np.random.default_rng(10)
    unit = lambda x: x / np.sqrt((x * x).sum(-1, keepdims=True))
    ones = unit(rng.standard_normal((4000, 64)))
    side = rng.standard_normal((150, 64))
    side = unit(side - (side * ones[:150]).sum(1, keepdims=True) * ones[:150])
    vectors = np.concatenate([ones, 0.981 * ones[:150] + np.sqrt(1 - 0.981**2) * side])
    table = spark.createDataFrame([(i, [float(x) for x in v], 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(table, trees=1, tries=1).collect()}
    assert found == {i: (1, i % 4000) if i % 4000 < 150 else (0, i) for i in range(4150)}


def test_license_scan(spark, docs, rows, clashing, empty):
    planted = [
        (1, "A page of words.\nThis project is licensed under the terms of the MIT license.\nMore words.", "mit"),
        (2, "Licensed under the Apache License, Version 2.0.", "apache-2.0"),
        (3, "The driver lost a license.\nThe court read the license agreement.", None),
        (4, "Released under the MIT License.\n" + prose(20, 1) + "\nLicensed under CC BY-SA 4.0.", "cc-by-sa,mit"),
        (5, prose(500, 4), None),
    ]
    found = license_scan.license_scan(spark.createDataFrame([x[:2] for x in planted], "doc_id long, text string")).collect()
    assert {r.doc_id: r.families for r in found} == {i: f for i, _, f in planted}
    assert all((r.n_confirmed > 0) == (r.families is not None) for r in found)
    plain = license_scan.license_scan(docs).collect()
    assert len(plain) == len(rows) and same(license_scan.license_scan(clashing).collect(), plain)
    assert license_scan.license_scan(empty).count() == 0


def test_chat(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "Ann", "hi <|im_end|>"), (1, 2, "Bob b", None), (1, 2, "Ann", "tie"), (1, 2, "Ann", "tie"), (1, None, None, "first"), (2, 0, "system", "alone"), (None, 1, "Ann", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat_format.perspectives(turns).collect()
    assert {(r.conv_id, r.perspective) for r in found} == {(1, "Ann"), (1, "Bob b"), (1, "unknown"), (None, "Ann")}
    for c, p in {(r.conv_id, r.perspective) for r in found}:
        parts = sorted((r for r in found if (r.conv_id, r.perspective) == (c, p)), key=lambda r: r.part)
        whole = "".join(r.text for r in parts)
        own = [whole[m.start : m.end] for r in parts for m in r.mask]
        said = sorted((x[3] or "").replace("<|im_", "<| im_") + "<|im_end|>" for x in rows if x[0] == c and (x[2] or "unknown") == p)
        assert sorted(own) == said and whole.count("<|im_start|>assistant\n") == len(said)
        assert "user name=assistant" not in whole
    assert any("user name=Bob_b\n" in r.text for r in found)
    more = chat_format.perspectives(turns.withColumns({c: F.lit(1) for c in CLASHES}))
    assert more.count() == len(found) and chat_format.perspectives(turns.where("false")).count() == 0


def test_warc(spark, tmp_path):
    big = "x" * 1200
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, "http://a b/é", "y" * 1100), (4, None, None), (5, "u", None), (6, "u", "small"), (7, "u", "small"), (None, "u", big), (8, "u", "é中" * 600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_roundtrip(pages).collect()}
    assert found == {1: (1200, "revisit", 2), 2: (1200, "response", None), 3: (1100, "response", None), 4: (0, "response", None), 5: (0, "response", None), 6: (5, "response", None), 7: (5, "response", None), None: (1200, "revisit", 2), 8: (3000, "response", None)}
    clash = pages.withColumns({c: F.lit(1) for c in ("payload", "record_type", "_n", "payload_digest", "_first")})
    assert warc.archive_roundtrip(clash).count() == len(rows)
    assert warc.archive_roundtrip(pages.where("false")).count() == 0
    # archives of other writers: plain, and gzip members without lengths
    record = "WARC/1.0\r\nWARC-Type: {}\r\nX-Page-Id: {}\r\nContent-Length: {}\r\n\r\n{}\r\n\r\n"
    made = [record.format(kind, i, 5000, ("%d" % i) * 5000).encode() for i, kind in enumerate(["warcinfo", "response", "request", "response"])]
    folder = tmp_path / uuid.uuid4().hex
    folder.mkdir()
    (folder / "a.warc").write_bytes(b"".join(made))
    (folder / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, made)))
    read = warc.read_warc(spark, str(folder)).where("record_type = 'response'").collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in read) == sorted((i, (b"%d" % i) * 5000) for i in (1, 3) for _ in "ab")
    plan = warc.read_warc(spark, str(folder)).where("page_id = 3")._jdf.queryExecution().toString()
    tested = [x for x in plan.split("== Physical Plan ==")[1].splitlines() if "Filter" in x and "Scan" not in x]
    assert not any("= 3" in x for x in tested), tested
    assert warc.read_warc(spark, str(folder)).where("page_id in (0, 3) and target_uri is null").count() == 4
