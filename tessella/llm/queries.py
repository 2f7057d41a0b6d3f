"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, chat_format, collocations, embedding_dedup, fill_middle, hidden_markov, license_scan, near_dedup, packing, quality_classifier, quality_rules, sharding, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bpe() -> str:
    """Path of the public tokenizer file, which the contracts of op5 and op7 name."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality_classifier.quality_classifier(docs, labels).drop("text")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_table(spark, sf_dir, "documents"), word_bpe())


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), word_bpe(), capacity=4096, end_id=1)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return quality_rules.quality_rules(docs).select("doc_id", *quality_rules.STATS, "base_failed", "kept", "distance")


QUERIES = {
    "op2_quality_classifier": op2_quality_classifier,
    "op5_bpe": op5_bpe,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op9_quality_rules": op9_quality_rules,
}

ORACLES: dict[str, str] = {}


def op10_minhash_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=80)


QUERIES["op10_minhash_lsh_forest"] = op10_minhash_lsh_forest


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_roundtrip(_table(spark, sf_dir, "pages"))


QUERIES["op3_warc"] = op3_warc
ORACLES["op3_warc"] = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS n, sha1(h) AS d FROM p),
r AS (SELECT *, MAX(page_id) OVER (PARTITION BY d) AS f FROM q)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND f <> page_id THEN f END AS refers_to
FROM r
"""


def op6_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), shards=40)


QUERIES["op6_histogram_sort"] = op6_histogram_sort


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.98)


QUERIES["op8_nn_descent"] = op8_nn_descent


def op1_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digest(chat_format.perspectives(_table(spark, sf_dir, "conversations")))


QUERIES["op1_chat_perspectives"] = op1_chat_perspectives
ORACLES["op1_chat_perspectives"] = chat_format.ORACLE


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_table(spark, sf_dir, "documents"))


QUERIES["op4_license_scan"] = op4_license_scan


def op12_wavelet_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return fill_middle.digest(fill_middle.fill_in_middle(docs, unit="line", seed="7", rate=100, spm_rate=50))


QUERIES["op12_wavelet_fim"] = op12_wavelet_fim
ORACLES["op12_wavelet_fim"] = fill_middle.ORACLE


def op11_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.language_model(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES["op11_hidden_markov"] = op11_hidden_markov


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("lang", "text")
    return collocations.collocations(docs, least=100, longest=5, top=2000)


QUERIES["op13_collocations"] = op13_collocations
ORACLES["op13_collocations"] = collocations.ORACLE
