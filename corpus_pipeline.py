"""From raw documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return the
columns of documents. run() writes each stage's result as Parquet in the shared folder and reads it again.

Defined cases: a null text is an empty one; it fails the base rules, as do texts of fewer than 20 words. Texts of any length
are used whole. Rows that share a doc_id are judged one by one by the first two stages; the third keeps one row of each
doc_id. Rows without a doc_id pass it, as no group can name them. An empty table gives an empty result of each stage.
Further columns of documents, whatever their names, come out of the first three stages as they went in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import near_dedup, packing, quality_classifier, quality_rules
from tessella.llm.queries import word_bpe
from tessella.llm.shared import stash


#: The columns that stages read.
READ = ("doc_id", "text", "lang", "source")


def beside(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage's rows of docs with docs' own columns: those that it doesn't read are out of reach of its results' names."""
    names = {c: f"_in{i}" for i, c in enumerate(docs.columns) if c not in READ}
    out = stage(docs.withColumnsRenamed(names))
    return out.select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and their group's covariance estimate accept."""
    return beside(docs, lambda rows: quality_rules.quality_rules(rows).where("kept"))


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of class 1 is at least 0.3. The model learns from the raw table's labelled rows, as
    the stage before has removed most of class 0; labels of held-out rows are never used."""
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality_classifier.fit(raw, labels.where(~quality_classifier.held_out(F.col("doc_id"))))
    return docs.where(quality_classifier.scorer(model)(F.col("text").cast("string")) >= 0.3)


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates; one row of each doc_id. Rows
    without a doc_id can't be named by a group and stay."""
    kept = near_dedup.near_duplicates(docs.where("doc_id is not null")).where("kept").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id is null"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 4096 tokens."""
    return packing.pack(docs, word_bpe(), capacity=4096, end_id=1)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("minhash_near_dedup", minhash_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can't express the estimates, the classifier and the search; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
