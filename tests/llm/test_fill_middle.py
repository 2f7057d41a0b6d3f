"""Fill-in-the-middle and its wavelet matrix against plain versions, and the defined cases."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import fill_middle
from tessella.llm.wavelet import WaveletMatrix


def test_wavelet_matrix():
    rng = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 1000, 4097):
        x = rng.choice(8, n, p=[0.5, 0.2, 0.1, 0.1, 0.05, 0.03, 0.02, 0]).astype(np.uint8)
        matrix = WaveletMatrix(x, 3)
        at = np.arange(n + 1)
        for c in range(8):
            own = np.concatenate([[0], np.cumsum(x == c)])
            assert (matrix.rank(c, at) == own).all()
            places = np.flatnonzero(x == c)
            if len(places):
                assert (matrix.select(c, np.arange(len(places))) == places).all()
        places = np.flatnonzero(np.isin(x, (0, 3, 4)))
        if len(places):
            assert (matrix.select_all((0, 3, 4), np.arange(len(places))) == places).all()


UNIT = {
    "line": re.compile(r"[^\n]*\n|[^\n]+"),
    "word": re.compile(r"[^\n\x0b\x0c\r \t]*[\n\x0b\x0c\r \t]|[^\n\x0b\x0c\r \t]+"),
    "sentence": re.compile(r"[^\n.!?]*[\n.!?]|[^\n.!?]+"),
    "char": re.compile(r"(?s)."),
}


def plain(key, text, unit, seed="7", rate=100, spm_rate=50):
    text = text or ""
    units = UNIT[unit].findall(text)
    n = len(units)
    digits = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    out = [(1, None), (2, ""), (3, "\n"), (4, "\n\n\n"), (5, "one line"), (6, "a\nb"), (7, "a\nb\n"), (8, "has <P> inside"), (9, "<S>"), (10, "<<S\n>x<M\n"), (None, "no\nkey\nhere"), (11, "\x0b\x0c\r \t")]
    for i in range(12, 400):
        out.append((i, "".join(draw.choice("ab é中\U0001f600.!?\n\r,<>SPM1") for _ in range(draw.randint(1, 90)))))
    out.append((400, "é long line.\n" * 40_000))
    out += [(401, "the same\nrow twice\n")] * 2
    return out


@pytest.mark.parametrize("unit", sorted(UNIT))
def test_against_plain_version(spark, rows, unit):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = fill_middle.fill_in_middle(docs, unit=unit, rate=80, spm_rate=30)
    back = fill_middle.restore(F.col("output"), F.col("form"))
    found = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", back.alias("restored"), F.coalesce("text", F.lit("")).alias("t")).collect()
    order = lambda x: (x[0] is None, x[0] or 0)
    assert sorted((tuple(r)[:6] for r in found), key=order) == sorted(((k, *plain(k, t, unit, rate=80, spm_rate=30)) for k, t in rows), key=order)
    assert all(r.restored == r.t for r in found)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_edges(spark, rows):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fill_middle.digest(fill_middle.fill_in_middle(empty)).collect() == []
    docs = spark.createDataFrame(rows[:12], "doc_id long, text string")
    clash = docs.withColumns({c: F.lit("in") for c in (*fill_middle.RESULTS, "text_", "a", "b", "h1")})
    made = fill_middle.fill_in_middle(clash)
    assert made.columns == ["doc_id", "text", "text_", "a", "b", "h1", *fill_middle.RESULTS]
    key = lambda r: (r.doc_id is None, r.doc_id)
    assert sorted(fill_middle.digest(made).collect(), key=key) == sorted(fill_middle.digest(fill_middle.fill_in_middle(docs)).collect(), key=key)
