"""A library that changes: stops between any two steps, conflicts, and searches that equal those of a rebuilt index."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessella.operators import index, upkeep
from tessella.sources.catalog import Catalog, Conflict
from tessella.sources.stash import new_path

DOCS = "doc_id string, name string, embed_model string, embed_done long"
CHUNKS = "doc_id string, idx int, section string, text string"
WORDS = "granite basalt crystal lens surface owl swift penguin flipper season".split()


def doc(n: int) -> list[tuple]:
    return [(f"d{n}", i, "", " ".join(WORDS[(n * 3 + i * k) % len(WORDS)] for k in range(1, 5 + (n + i) % 4)) if (n + i) % 6 else "") for i in range(4)]


def add(catalog, spark, *numbers):
    docs = spark.createDataFrame([(f"d{n}", f"Doc {n}", "m1", 0) for n in numbers], DOCS)
    chunks = spark.createDataFrame([c for n in numbers for c in doc(n)], CHUNKS)
    members = spark.createDataFrame([("even" if n % 2 == 0 else "odd", f"d{n}") for n in numbers], "collection_id string, doc_id string")
    return upkeep.add_documents(catalog, docs, chunks, members)


def vectors(spark, *numbers):
    return spark.createDataFrame([(f"d{n}", i, "m1", [1, n, i], 0.5) for n in numbers for i in range(4)], "doc_id string, idx int, model string, q array<tinyint>, scale float")


def gone(spark, *numbers):
    return spark.createDataFrame([(f"d{n}",) for n in numbers], "doc_id string")


def state(catalog) -> dict:
    manifest = catalog.manifest()
    out = {n: sorted(map(str, (r.asDict() for r in catalog.table(n, manifest).collect()))) for n in manifest.tables if n != "terms"}
    return out | {"df": sorted((r.term, r.df) for r in upkeep.open_index(catalog, manifest).terms.collect())} if "terms" in manifest.tables else out


def search(found, spark):
    asked = spark.createDataFrame([(i, w) for i, w in enumerate(["granite lens", "owl", "swift season flipper"])], "query_id int, question string")
    return sorted((r.query_id, r.doc_id, r.idx, r.score, r.rank) for r in index.bm25_search(found, index.query_terms(asked), 50).collect())


def rebuilt(spark, *numbers):
    path = new_path(spark, "rebuilt")
    index.build(spark.createDataFrame([c for n in numbers for c in doc(n)], CHUNKS), path)
    return index.open_index(spark, path)


def same_index(catalog, spark, *numbers):
    own, new = upkeep.open_index(catalog), rebuilt(spark, *numbers)
    assert search(own, spark) == search(new, spark)
    for name in ("terms", "documents", "lengths"):
        a, b = getattr(own, name), getattr(new, name)
        assert sorted(map(tuple, a.select(b.columns).collect())) == sorted(map(tuple, b.collect())), name


def test_add_remove_and_merge_equal_a_rebuild(spark):
    catalog = Catalog(spark, new_path(spark, "library"))
    assert catalog.manifest().version == 0
    add(catalog, spark, 1, 2, 3, 4, 5)
    add(catalog, spark, 6)
    same_index(catalog, spark, 1, 2, 3, 4, 5, 6)
    upkeep.remove_documents(catalog, gone(spark, 2, 5, 99))
    same_index(catalog, spark, 1, 3, 4, 6)
    add(catalog, spark, 5)  # a document comes back
    same_index(catalog, spark, 1, 3, 4, 5, 6)
    with pytest.raises(ValueError, match="there already"):
        add(catalog, spark, 5)
    before = catalog.manifest()
    upkeep.merge_index(catalog, share=0.0)
    same_index(catalog, spark, 1, 3, 4, 5, 6)
    assert len(catalog.manifest().tables["terms"]) == 1 < len(before.tables["terms"])
    swept = catalog.sweep()
    assert swept and any(s.startswith("manifests/") for s in swept) and not catalog.sweep()
    same_index(catalog, spark, 1, 3, 4, 5, 6)


def test_a_merge_rewrites_only_touched_buckets(spark):
    catalog = Catalog(spark, new_path(spark, "library"))
    add(catalog, spark, *range(1, 9))
    chunk = spark.createDataFrame([("x", 0, "", "granite")], CHUNKS)
    upkeep.add_documents(catalog, spark.createDataFrame([("x", "X", "m1", 0)], DOCS), chunk)
    first = catalog.manifest().tables["postings"][0]
    merged = upkeep.merge_index(catalog, share=0.0).tables["postings"]
    assert merged[0].path == first.path and len(merged) == 3
    bucket = spark.range(1).select(index.bucket_of(F.lit("granite"), 16).alias("b")).first().b
    assert merged[-1].buckets == (bucket,) and bucket not in merged[0].buckets and len(merged[0].buckets) == 15
    again = upkeep.merge_index(catalog, share=0.0).tables["postings"]
    assert again == merged  # nothing is touched any more
    found = {r.doc_id for r in upkeep.open_index(catalog).postings.where("term = 'granite'").collect()}
    assert "x" in found and len(found) > 1


def test_every_stop_leaves_one_state(spark):
    root = new_path(spark, "library")
    catalog = Catalog(spark, root)
    add(catalog, spark, 1, 2, 3)
    upkeep.add_vectors(catalog, vectors(spark, 1, 2, 3))

    def runs(change):
        old, base = state(catalog), catalog.manifest().version
        change(catalog)
        assert state(catalog) != old and catalog.manifest().version == base + 1

    class Stop(Exception):
        pass

    for change in (
        lambda c: upkeep.remove_documents(c, gone(spark, 2)),
        lambda c: upkeep.reset_model(c, gone(spark, 1), "m2"),
        lambda c: add(c, spark, 7),
    ):
        probe = Catalog(spark, root)
        names = []
        before, manifest = state(probe), probe.manifest()

        def count(step):
            names.append(step)
            if step == "rename manifest":
                raise Stop

        with pytest.raises(Stop):
            change(Catalog(spark, root, count))
        for n in range(len(names)):
            left = [n]

            def stop(step):
                if not left[0]:
                    raise Stop
                left[0] -= 1

            with pytest.raises(Stop):
                change(Catalog(spark, root, stop))
            assert probe.manifest() == manifest, names[n]  # segments never change, so neither do the tables
        assert state(probe) == before
        runs(change)
    rows = {r.doc_id: (r.embed_model, r.embed_done) for r in catalog.table("docs").collect()}
    assert rows == {"d1": ("m2", 0), "d3": ("m1", 4), "d7": ("m1", 0)}
    assert {r.doc_id for r in catalog.table("vectors").collect()} == {"d3"} and {r.doc_id for r in catalog.table("members").collect()} == {"d1", "d3", "d7"}
    catalog.sweep()
    same_index(catalog, spark, 1, 3, 7)


def test_two_writers(spark):
    root = new_path(spark, "library")
    add(Catalog(spark, root), spark, 1)
    first, second = Catalog(spark, root), Catalog(spark, root)
    a = first.overwrite(first.manifest(), "members", spark.createDataFrame([("x", "d1")], "collection_id string, doc_id string"))
    b = second.overwrite(second.manifest(), "members", spark.createDataFrame([("y", "d1")], "collection_id string, doc_id string"))
    first.commit(a)
    with pytest.raises(Conflict):
        second.commit(b)
    assert [r.collection_id for r in first.table("members").collect()] == ["x"]
    assert [r.collection_id for r in first.table("members", first.manifest(1)).collect()] == ["odd"]
