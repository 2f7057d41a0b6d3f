"""A library that changes: documents are added and removed, models reset, and the keyword index follows.

All tables of a library are in one catalog, so each operation is one switch of its manifest. An added document brings
its own segments of every table; document frequencies and sizes are tables of additions, so a search needs no rebuild. A
removed document leaves a note on the large tables and its frequencies as negative additions; small tables are rewritten.
"""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import index
from tessella.operators.rows import broadcast_if_small
from tessella.sources.catalog import Catalog, Manifest
from tessella.sources.stash import drop_stash, stash

#: Tables with a row for each chunk or more, from which rows are removed by notes.
LARGE = ("chunks", "vectors", "postings", "lengths")
#: Tables with a row for each document, which a removal rewrites.
SMALL = ("docs", "members", "sizes")
#: Postings of a bucket at which a new library aims.
BUCKET_ROWS = 2_000_000


def _present(catalog: Catalog, base: Manifest, docs: DataFrame) -> None:
    if "docs" in base.tables:
        again = catalog.table("docs", base).join(docs.select("doc_id"), "doc_id", "left_semi").limit(1).collect()
        if again:
            raise ValueError(f"document {again[0].doc_id!r} is there already; remove it first")


def add_documents(catalog: Catalog, docs: DataFrame, chunks: DataFrame, members: DataFrame | None = None) -> Manifest:
    """Add docs (doc_id, name, embed_model, embed_done) with their chunks (doc_id, idx, section, text, ..), and their places in
    collections (collection_id, doc_id): one version."""
    base = catalog.manifest()
    _present(catalog, base, docs)
    counts = index.chunk_terms(chunks, F.concat_ws("\n", "section", "text"))
    if "buckets" not in base.settings:
        buckets = min(4096, max(16, math.ceil(index.posting_count(counts) / BUCKET_ROWS)))
        base = replace(base, settings=base.settings | {"buckets": buckets})
    lengths = index.chunk_lengths(counts)
    postings = index.posting_rows(counts, int(base.settings["buckets"]))
    new = catalog.append(base, "docs", docs)
    new = catalog.append(new, "chunks", chunks)
    if members is not None:
        new = catalog.append(new, "members", members.select("collection_id", "doc_id").distinct())
    new = catalog.append(new, "lengths", lengths)
    new = catalog.append(new, "postings", postings, "bucket")
    new = catalog.append(new, "terms", index.term_frequencies(counts))
    new = catalog.append(new, "sizes", lengths.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("dl").alias("total")))
    new = catalog.commit(new)
    drop_stash(counts)
    return new


def add_vectors(catalog: Catalog, vectors: DataFrame) -> Manifest:
    """Add vectors (doc_id, idx, model, q, scale) and set their documents' progress: one version."""
    base = catalog.manifest()
    rows = stash(vectors, "new-vectors")
    done = rows.groupBy("doc_id").agg(F.count("*").alias("_new"))
    docs = catalog.table("docs", base).join(done, "doc_id", "left")
    docs = docs.withColumn("embed_done", (F.coalesce("embed_done", F.lit(0)) + F.coalesce("_new", F.lit(0))).cast("long")).drop("_new")
    new = catalog.commit(catalog.overwrite(catalog.append(base, "vectors", rows), "docs", docs))
    drop_stash(rows)
    return new


def remove_documents(catalog: Catalog, gone: DataFrame) -> Manifest:
    """Remove documents (doc_id) and all that belongs to them from every table: one version."""
    base = catalog.manifest()
    keys = stash(gone.select("doc_id").distinct(), "gone")
    few = broadcast_if_small(keys)
    lost = catalog.table("postings", base).join(few, "doc_id", "left_semi").groupBy("term").agg((-F.count("*")).alias("df"))
    new = catalog.append(base, "terms", lost)
    for name in SMALL:
        if name in base.tables:
            new = catalog.overwrite(new, name, catalog.table(name, base).join(few, "doc_id", "left_anti"))
    new = catalog.note(new, [n for n in LARGE if n in base.tables], catalog.write("gone", keys))
    new = catalog.commit(new)
    drop_stash(keys)
    return new


def reset_model(catalog: Catalog, docs: DataFrame, model: str) -> Manifest:
    """Give documents (doc_id) another embedding model: their vectors and progress go in the same version."""
    base = catalog.manifest()
    keys = stash(docs.select("doc_id").distinct(), "reset")
    hit = broadcast_if_small(keys.withColumn("_hit", F.lit(True)))
    rows = catalog.table("docs", base).join(hit, "doc_id", "left")
    of = lambda new, old: F.when(F.col("_hit"), new).otherwise(F.col(old))
    kind = dict(rows.dtypes)["embed_done"]
    rows = rows.withColumns({"embed_model": of(F.lit(model), "embed_model"), "embed_done": of(F.lit(0).cast(kind), "embed_done")}).drop("_hit")
    new = catalog.overwrite(base, "docs", rows)
    if "vectors" in base.tables:
        new = catalog.note(new, ["vectors"], catalog.write("gone", keys))
    new = catalog.commit(new)
    drop_stash(keys)
    return new


def merge_index(catalog: Catalog, share: float = 0.1) -> Manifest:
    """Bring small segments and removed rows together where they matter: of the postings only the buckets are rewritten of whose
    rows more than ``share`` are outside of one segment or gone; frequencies are added up, and the sizes become one segment."""
    base = catalog.manifest()
    segments = base.tables["postings"]
    sizes = lambda own: catalog.table("postings", replace(base, tables={"postings": own})).groupBy("bucket").agg(F.count("*").alias("n"))
    stored = sizes(tuple(replace(s, without=()) for s in segments)).withColumnRenamed("n", "stored")
    each = sizes(segments[:1])
    for s in segments[1:]:
        each = each.unionByName(sizes((s,)))
    largest = each.groupBy("bucket").agg(F.max("n").alias("n"))
    counts = stored.join(largest, "bucket", "left").where(F.col("stored") - F.coalesce("n", F.lit(0)) > share * F.col("stored"))
    touched = sorted(r.bucket for r in counts.select("bucket").collect())  # at most settings["buckets"]
    new = catalog.merge(base, "postings", "bucket", touched)
    terms = catalog.table("terms", base).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
    return catalog.commit(catalog.merge(catalog.overwrite(new, "terms", terms), "sizes"))


def open_index(catalog: Catalog, manifest: Manifest | None = None) -> index.Index:
    """The keyword index of a version."""
    manifest = manifest or catalog.manifest()
    terms = catalog.table("terms", manifest).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    postings, lengths = (catalog.table(n, manifest) for n in ("postings", "lengths"))
    return index.Index(postings, lengths, catalog.table("sizes", manifest), terms, int(manifest.settings["buckets"]))
