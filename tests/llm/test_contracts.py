"""The queries opN_<name> against plain versions of their definitions, on whole small tables."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import license_scan, near_dedup, quality_rules, queries
from tests.compare import TESTDATA, difference
from tests.llm import brute

SF = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(queries.word_bpe())
    found.no_truncation()
    found.no_padding()
    return found


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    assert difference(spark, name, queries.QUERIES[name], queries.ORACLES[name], SF) == ""


def test_quality_classifier(spark):
    rows = queries.op2_quality_classifier(spark, f"{TESTDATA}/sf0.01").collect()
    n, ids = duckdb.sql(f"SELECT COUNT(*), COUNT(DISTINCT doc_id) FROM '{TESTDATA}/sf0.01/documents.parquet'").fetchall()[0]
    assert len(rows) == n and len({r.doc_id for r in rows}) == ids
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{TESTDATA}/sf0.01/labels.parquet'").fetchall())
    held = [(labels[r.doc_id], r.predicted, r.score) for r in rows if r.held_out and r.doc_id in labels]
    accuracy = np.mean([a == b for a, b, _ in held])
    good = np.array([s for a, _, s in held if a == 1])
    bad = np.array([s for a, _, s in held if a == 0])
    auc = (good[:, None] > bad[None]).mean()
    assert len(held) > 40 and accuracy >= 0.85 and auc >= 0.9, (accuracy, auc)


def test_bpe(spark, docs, tokenizer):
    for r in queries.op5_bpe(spark, SF).collect():
        ids = tokenizer.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids), r.doc_id
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_histogram_sort(spark, docs):
    rows = queries.op6_histogram_sort(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(sizes) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    # ranges of whole rows: a shard is off by two rows at most
    assert max(abs(s - sum(sizes.values()) / 40) for s in sizes.values()) <= 2 * max(r.size for r in rows)


def check_packing(rows, ids_of, capacity=4096):
    """Pieces are those of the documents, in gapless sequences; returns the number of sequences."""
    found, placed = defaultdict(list), defaultdict(list)
    for r in rows:
        found[r.doc_id].append(r)
        placed[r.sequence_id].append((r.offset, r.length))
    for doc_id, pieces in found.items():
        ids = [*ids_of(doc_id), 1]
        want = [(i // capacity, i, ids[i : i + capacity]) for i in range(0, len(ids), capacity)]
        have = sorted((p.piece, p.start, p.length, p.ids_crc32) for p in pieces)
        assert have == [(n, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for n, at, x in want]
    for own in placed.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(placed)


def test_best_fit_packing(spark, docs, tokenizer):
    rows = queries.op7_best_fit_packing(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(docs)
    bins = check_packing(rows, lambda i: tokenizer.encode(docs[i] or "", add_special_tokens=False).ids)
    assert bins <= -(-sum(r.length for r in rows) // 4096) + 1


def test_nn_descent(spark):
    table = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{SF}/embeddings.parquet'").fetchall()
    want = brute.near_vectors(table, 0.98)
    rows = queries.op8_nn_descent(spark, SF).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in rows} == want and len(rows) == len(table)
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)


def test_quality_rules(spark, docs):
    rows = queries.op9_quality_rules(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        have = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert have == brute.statistics(docs[r.doc_id]), r.doc_id
        assert not (r.base_failed and r.kept)


def test_quality_rules_verdict(spark):
    """Distances and verdicts row by row against a plain version of the estimate."""
    frame = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet").select("doc_id", "lang", "source", "text")
    rows = quality_rules.quality_rules(frame, min_rows=60).collect()
    good = [r for r in rows if not r.base_failed]
    sizes = Counter((r.lang, r.source) for r in good)
    pools = Counter(r.lang for r in good if sizes[r.lang, r.source] < 60)
    group = lambda r: (r.lang, r.source) if sizes[r.lang, r.source] >= 60 else r.lang if pools[r.lang] >= 60 else None
    groups = defaultdict(list)
    for r in good:
        groups[group(r)].append(r)
    checked = 0
    for own in groups.values():
        x = [[np.log((r.word_chars + 150) / (r.n_words + 30)), np.log1p(r.n_symbols / (r.n_words + 1)), r.n_dup_lines / (r.n_words / 8 + r.n_dup_lines + 1), r.n_repeat_words / (r.n_words + 30)] for r in own]
        if len(own) < 60:
            continue
        want = brute.outlier_distances(np.array(x), np.array(quality_rules.FLOORS))
        for r, d in zip(own, want):
            assert abs(r.distance - d) <= 0.02 * d + 1e-6, (r.doc_id, r.distance, d)
            assert r.kept == (d <= quality_rules.chi2_quantile(0.99999, 4))
            checked += 1
    assert checked > 500


def test_license_scan(spark, docs):
    """The query's families against plain splitting, scoring and comparison by the same weights, wrapped notices included."""
    import textwrap

    made = {-1 - i: "Title\n\n" + "\n".join(" * " + line for line in textwrap.wrap(t, 70)) + "\n\nMore text." for i, t in enumerate(x for ts in license_scan.all_templates().values() for x in ts)}
    every = {**docs, **made}
    frame = spark.createDataFrame(list(every.items()), "doc_id long, text string")
    model = license_scan.fit(frame)
    vocabulary = {g: i for i, g in enumerate(model.vectors.vocabulary)}
    weights, bias = model.classifier.coefficientMatrix.toArray(), model.classifier.interceptVector.toArray()
    rows = license_scan.license_scan(frame, model=model).collect()
    found = {r.doc_id: r.families for r in rows}
    assert found == {i: brute.licences(t, vocabulary, weights, bias, model.heat, model.least, license_scan.CLASSES, license_scan.all_templates()) for i, t in every.items()}
    names = [f for f, ts in license_scan.all_templates().items() for _ in ts]
    wanted = {"unknown": None, "bsd": "bsd-2-clause"}
    wrong = [(f, found[-1 - i]) for i, f in enumerate(names) if found[-1 - i] != wanted.get(f, f)]
    assert len(names) > 100 and len(wrong) <= 4, wrong
    assert 0 < model.least < 1


BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.
"""
#: Notices as files have them, and what they are.
NOTICES = [
    (BSD, "bsd-2-clause"),
    (BSD + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote\nproducts derived from this software without specific prior written permission.\n", "bsd-3-clause"),
    ("This package is not licensed under the terms of the MIT license.", None),
    ("MIT License\n\nCopyright (c) 2020 A Person", "mit"),
    ("License: Apache-2.0", "apache-2.0"),
    ("Classifier: License :: OSI Approved :: BSD License", "bsd-2-clause"),
    ("Classifier: License :: OSI Approved :: MIT License", "mit"),
    ("# SPDX-License-Identifier: GPL-2.0-only", "gpl"),
    ("// Licensed under the Apache License, Version 2.0 (the\n// License); you may not use this file except in\n// compliance with the License.", "apache-2.0"),
    ("The dog was licensed by the city, and a fee was paid for the license.", None),
    ("He never released the film under a studio's name.", None),
]


def test_license_notices(spark, docs):
    made = {-1 - i: t for i, (t, _) in enumerate(NOTICES)}
    frame = spark.createDataFrame(list({**docs, **made}.items()), "doc_id long, text string")
    found = {r.doc_id: r.families for r in license_scan.license_scan(frame).collect()}
    assert [(t[:50], found[-1 - i]) for i, (t, _) in enumerate(NOTICES)] == [(t[:50], f) for t, f in NOTICES]


@pytest.mark.parametrize("percent", [40, 60])
def test_minhash_other_similarity(spark, docs, percent):
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    rows = near_dedup.near_duplicates(frame, k=4, percent=percent, crowd=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute.near_duplicates(docs, 4, percent)


def test_minhash_lsh_forest(spark, docs):
    want = brute.near_duplicates(docs, 4, 80)
    rows = queries.op10_minhash_lsh_forest(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want and len(rows) == len(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_minhash_lsh_forest_larger(spark):
    larger = dict(duckdb.sql(f"SELECT doc_id, text FROM '{TESTDATA}/sf0.01/documents.parquet'").fetchall())
    rows = queries.op10_minhash_lsh_forest(spark, f"{TESTDATA}/sf0.01").collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute.near_duplicates(larger, 4, 80)


def test_pipeline(spark, tokenizer):
    """Stage by stage: the rules' and the classifier's own verdicts, brute-force near-duplicates, whole packing."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in queries.op9_quality_rules(spark, SF).where("kept").collect()}
    scored = {r.doc_id for r in queries.op2_quality_classifier(spark, SF).where("predicted = 1").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept & scored}
    want = {i for i, (_, low) in brute.near_duplicates(texts, 5, 80).items() if i == low}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == want
    check_packing(rows, lambda i: tokenizer.encode(texts[i], add_special_tokens=False).ids)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_pipeline_keeps_the_columns_of_documents(spark):
    """Columns named like a stage's own results, null and empty texts, repeated rows, rows without an id, an empty table."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    table = spark.read.parquet(f"{SF}/documents.parquet")
    own = {c: F.lit("mine") for c in ("n_words", "kept", "component_id", "score", "distance", "m0", "held_out", "base_failed", "_g")}
    docs = table.unionByName(table.limit(3)).unionByName(table.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    docs = docs.unionByName(table.limit(2).withColumns({"doc_id": F.col("doc_id") + 10**6, "text": F.lit(None).cast("string")})).withColumns(own)
    plain, kept = table, docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain, kept = stage(spark, plain, SF), stage(spark, kept, SF)
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert all(r[c] == "mine" for r in rows for c in own) and all(r.text is not None for r in rows)
        assert len(rows) >= plain.count() > 0
    assert corpus_pipeline.STAGES[0][1](spark, docs.where("false"), SF).count() == 0
