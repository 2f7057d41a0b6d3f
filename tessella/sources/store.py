"""Stored tables: Parquet by document, deletion, packs, exports, slim records, cached model outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.stash import drop_stash, file_system, stash

PACK = "tessella-pack-1"
PACK_SCHEMA = (
    "format string, doc struct<name: string, kind: string, embed_model: string>, "
    "chunks array<struct<idx: int, page: int, section: string, text: string, tokens: int>>, vectors array<struct<idx: int, q: string, scale: float>>"
)


def save(rows: DataFrame, path: str, by: str | None = None, mode: str = "append") -> None:
    writer = rows.write.mode(mode)
    (writer.partitionBy(by) if by else writer).parquet(path)


def load(spark: SparkSession, path: str, **equal) -> DataFrame:
    """A stored table with equality filters, which reach the partitions and the scan."""
    rows = spark.read.parquet(path)
    for name, value in equal.items():
        rows = rows.where(F.col(name) == value)
    return rows


def load_vectors(vectors: DataFrame, docs: DataFrame) -> DataFrame:
    """Vectors of each document's own model, up to its recorded progress."""
    rows = vectors.join(docs.select("doc_id", "embed_model", "embed_done"), "doc_id")
    return rows.where((F.col("model") == F.col("embed_model")) & (F.col("idx") < F.col("embed_done"))).drop("embed_model", "embed_done")


def without(rows: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows whose key isn't in gone: a cascade applies it to each table of a document."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def delete_documents(spark: SparkSession, tables: dict[str, str], gone: DataFrame) -> None:
    """Remove documents from each table: the rest is written beside it and takes its place, one table at a time."""
    jvm = spark._jvm
    for path in tables.values():
        rest = without(spark.read.parquet(path), gone)
        rest.write.mode("overwrite").parquet(path + ".next")
        old, new = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, path + ".next"))
        fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.delete(old, True)
        fs.rename(new, old)


def add_members(collections: DataFrame, added: DataFrame) -> DataFrame:
    """Bridge table (collection_id, doc_id) with new members, each once."""
    return collections.unionByName(added).distinct()


def of_collection(rows: DataFrame, members: DataFrame, collection_id) -> DataFrame:
    return rows.join(members.where(F.col("collection_id") == collection_id), "doc_id", "left_semi")


def export_pack(docs: DataFrame, chunks: DataFrame, vectors: DataFrame, path: str) -> None:
    """One JSON line a document, gzip: metadata without its id, chunks, vectors in base64. Documents are exported one by
    one in the reference; here each is a row of its own size."""
    c = chunks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("idx", "page", "section", "text", "tokens"))).alias("chunks"))
    q = F.base64(F.unhex(F.array_join(F.transform("q", lambda x: F.lpad(F.hex(x.cast("int").bitwiseAND(F.lit(255))), 2, "0")), "")))
    v = vectors.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("idx", q.alias("q"), "scale"))).alias("vectors"))
    rows = docs.join(c, "doc_id", "left").join(v, "doc_id", "left")
    packed = F.struct(F.lit(PACK).alias("format"), F.struct("name", "kind", "embed_model").alias("doc"), "chunks", "vectors")
    rows.select(F.to_json(packed).alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)


def import_pack(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, chunks, vectors) with fresh ids; a row with another format tag fails."""
    rows = spark.read.schema(PACK_SCHEMA).json(path)
    checked = F.when(F.col("format") == PACK, F.sha1(F.to_json(F.struct("doc", "chunks")))).otherwise(F.raise_error(F.lit("not a pack of this format")).cast("string"))
    rows = rows.withColumn("doc_id", checked)
    docs = rows.select("doc_id", "doc.*")
    chunks = rows.select("doc_id", F.inline("chunks"))
    vectors = rows.select("doc_id", F.inline("vectors"))
    hexed = F.hex(F.unbase64("q"))
    signed = lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    places = F.sequence(F.lit(0), (F.length(hexed) / 2).cast("int") - 1)
    q = F.transform(places, lambda i: F.when(signed(i) > 127, signed(i) - 256).otherwise(signed(i)).cast("tinyint"))
    return docs, chunks, vectors.withColumn("q", q)


def lab_csv(results: DataFrame, path: str) -> None:
    """All columns quoted, quotes doubled, with a header."""
    plain = results.select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in results.columns])
    plain.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', emptyValue="")


def session_markdown(messages: DataFrame) -> DataFrame:
    """(session_id, markdown) of messages (session_id, turn, question, answer): a session is a person's thread."""
    line = F.concat(F.lit("## "), "question", F.lit("\n\n"), F.coalesce("answer", F.lit("")))
    rows = messages.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))).alias("x"))
    return rows.select("session_id", F.array_join(F.transform("x", lambda x: x["l"]), "\n\n").alias("markdown"))


def slim(runs: DataFrame) -> DataFrame:
    """Records without the prompt and without their sources' texts."""
    return runs.drop("prompt").withColumn("sources", F.transform("sources", lambda s: s.dropFields("text")))


def hydrate(sources: DataFrame, chunks: DataFrame, placeholder: str = "(This passage is no longer in the library.)") -> DataFrame:
    """Sources (doc_id, idx, ...) with their chunk's text; a missing chunk gives a placeholder."""
    rows = sources.join(chunks.select("doc_id", "idx", F.col("text").alias("_t")), ["doc_id", "idx"], "left")
    return rows.withColumn("text", F.coalesce("_t", F.lit(placeholder))).drop("_t")


def missing_outputs(inputs: DataFrame, cache: DataFrame, text: str, namespace: str) -> DataFrame:
    """Distinct texts whose model output isn't in the cache (namespace, key), by SHA-1."""
    keyed = inputs.select(F.sha1(F.col(text)).alias("key"), F.col(text)).dropDuplicates(["key"])
    return keyed.join(cache.where(F.col("namespace") == namespace).select("key"), "key", "left_anti")


def namespace_of(spark: SparkSession, path: str, probes: DataFrame, near: float = 1e-3) -> str:
    """The namespace of the cache at path whose stored probe outputs are those of probes (probe_no, output array<double>) up to
    ``near`` in every number; a new one where there is none, as after a change of the model."""
    folder = f"{path}/namespaces"
    fs, place = file_system(spark, folder)
    stored = spark.read.parquet(folder) if fs.exists(place) else spark.createDataFrame([], "namespace string, probe_no int, output array<double>")
    now = probes.select(F.col("probe_no").cast("int").alias("probe_no"), F.col("output").alias("now"))
    both = stored.join(now, "probe_no", "full")
    apart = F.exists(F.zip_with("output", "now", lambda a, b: F.coalesce(F.abs(a - b) > near, F.lit(True))), lambda x: x)
    same = F.coalesce(~apart, F.lit(False))
    n = now.count()  # a model has a few probes
    hits = both.groupBy("namespace").agg(F.bool_and(same).alias("same"), F.count("*").alias("k")).where(F.col("same") & (F.col("k") == n) & F.col("namespace").isNotNull())
    found = hits.agg(F.min("namespace")).first()[0]
    if found is None:
        found = f"ns{stored.select('namespace').distinct().count() + 1:04d}"
        now.select(F.lit(found).alias("namespace"), "probe_no", F.col("now").alias("output")).coalesce(1).write.mode("append").parquet(folder)
    return found


def cached_outputs(spark: SparkSession, path: str, inputs: DataFrame, text: str, namespace: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, output) of all distinct texts: those in the cache are read, compute sees (key, text) of the others only, once each, and
    what it gives (key, output) is kept for later runs."""
    folder = f"{path}/outputs/namespace={namespace}"
    fs, place = file_system(spark, folder)
    stored = spark.read.parquet(folder).dropDuplicates(["key"]) if fs.exists(place) else None
    cache = stored.withColumn("namespace", F.lit(namespace)) if stored is not None else spark.createDataFrame([], "key string, namespace string")
    missing = stash(missing_outputs(inputs.where(F.col(text).isNotNull()), cache, text, namespace), "missing-outputs")
    if missing.limit(1).count():
        compute(missing).select("key", "output").write.mode("append").parquet(folder)
    drop_stash(missing)
    wanted = inputs.where(F.col(text).isNotNull()).select(F.sha1(F.col(text)).alias("key")).distinct()
    if not fs.exists(place):
        return wanted.withColumn("output", F.lit(None)).where("false")
    return spark.read.parquet(folder).dropDuplicates(["key"]).join(wanted, "key", "left_semi")
