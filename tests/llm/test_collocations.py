"""Phrase collocations against a plain count of all phrases, and the defined cases."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessella.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, longest, top):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in counts.items():
        n, found = total[lang], []
        frequent = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        for p, a in frequent.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in frequent.items()):
                continue
            score, _, l, r = min((1000 * a * n // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(8)
    words = ["the", "The", "of", "state", "art", "é", "中文", "x-ray", "in", "spite", "rare", "\xa0odd", "a\x00b", "<s>"]
    out = [(1, None, "en"), (2, "", "en"), (3, " \t,.\n", None), (4, "one", "fr"), (5, "in spite of the state of the art. " * 300, "en")]
    for i in range(6, 500):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  "]) for _ in range(draw.randint(1, 60)))
        out.append((i, text, draw.choice(["en", "en", "en", "de", None])))
    return out + [out[20]] * 30


@pytest.mark.parametrize("least, longest, top, chunk", [(20, 5, 2000, 8 << 20), (8, 5, 40, 2000), (100, 3, 7, 300)])
def test_against_plain_version(spark, rows, least, longest, top, chunk):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = C.collocations(docs, least=least, longest=longest, top=top, chunk=chunk).collect()
    want = plain(rows, least, longest, top)
    assert len(want) > 5 and sorted(map(tuple, found)) == want


def test_joins_without_broadcast(spark, rows, monkeypatch):
    monkeypatch.setattr(C, "SMALL", 0)
    monkeypatch.setattr(C, "DENSE", 50)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, C.collocations(docs, least=20).collect())) == plain(rows, 20, 5, 2000)


def test_tiles():
    rng = np.random.default_rng(1)
    for most, side, dense in ((5, 2, 3), (5000, 64, 40), (300_000, 1024, 500), (90, 1, 1), (1 << 30, 1024, 10)):
        a, b = (np.minimum(rng.zipf(1.2, 20_000) % most, most) + 1 for _ in range(2))
        x, y, n = C.pair_counts(a.astype(np.int32), b.astype(np.int32), side, dense)
        assert Counter(dict(zip(zip(x.tolist(), y.tolist()), n.tolist()))) == Counter(zip(a.tolist(), b.tolist())) and len(x) == len(set(zip(x.tolist(), y.tolist())))
    assert all(len(v) == 0 for v in C.pair_counts(np.zeros(0, np.int32), np.zeros(0, np.int32)))


def test_scores_beyond_64_bits(spark):
    a, l, r, n = 9_876_543_210_123, 9_999_999_999_999, 9_876_543_210_987, 123_456_789_012_345
    phrases = spark.createDataFrame([("en", ["big", "number"], a), ("en", ["big"], l), ("en", ["number"], r)], "lang string, words array<string>, f long")
    found = C.rank_phrases(phrases, spark.createDataFrame([("en", n)], "lang string, n long"), 10).collect()
    assert [tuple(x) for x in found] == [("en", 1, "big number", a, l, r, n, 1000 * a * n // (l * r))]


def test_edges(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "Same words here. " * 60, "en"), (1, "Same words here. " * 60, "en"), (2, "x y " * 200_000, None), (3, None, None), (4, "w" * 400_000 + " w", "en")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'in' as chunk", "1 as f", "2 as a", "3 as n", "4 as id", "5 as words", "6 as symbols", "7 as _g")
    assert sorted(map(tuple, C.collocations(docs).collect())) == plain(rows, 100, 5, 2000)


def test_bounded_sums(spark, rows, monkeypatch):
    """Tasks that may hold a few entries only hand on more rows, which Spark adds up."""
    plain_pairs = C._pairs
    monkeypatch.setattr(C, "_pairs", lambda chunks, least: plain_pairs(chunks, least, most=10))
    monkeypatch.setattr(C, "AT_ONCE", 500)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    assert sorted(map(tuple, C.collocations(docs, least=20, chunk=1000).collect())) == plain(rows, 20, 5, 2000)
