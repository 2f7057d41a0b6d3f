"""Test material of reading benchmarks: swapped facts, and answers compared as words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.text import sentences, unmarked
from tessella.operators import measure
from tessella.operators.rows import broadcast_if_small
from tessella.sources.stash import stash

#: Letters of an answer by which it is looked for in a paragraph.
GRAM = 4


def norm_answer(text: Column) -> Column:
    """Lower case without marks; what is neither a letter nor a digit becomes one space."""
    return F.btrim(F.regexp_replace(F.lower(unmarked(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", " "))


def answer_tokens(text: Column) -> Column:
    """Words of an answer without articles."""
    return F.filter(F.split(norm_answer(text), " "), lambda w: (w != "") & ~w.isin("a", "an", "the"))


def answer_f1(predicted: DataFrame, golds: DataFrame) -> DataFrame:
    """(query_id, f1): the best of the golds (query_id, gold_no, answer) for each predicted answer (query_id, answer)."""
    words = answer_tokens(F.col("answer")).alias("terms")
    return measure.token_f1(predicted.select("query_id", words), golds.select("query_id", "gold_no", words))


def swap_picks(questions: DataFrame, most: int = 40, block: int = 256) -> DataFrame:
    """questions (title, paragraph_no, question_no, id, context, answer) with kind and other: an answer of the same kind (number
    or name) of the same article that the question's own paragraph doesn't hold, picked by paragraph and question number. Rows
    without any are left out.

    The pool of a question is its article's short answers in order without those in its paragraph. An article's questions are
    dealt into blocks of about ``block``; each block gets the article's short answers of its kind, a few bytes each."""
    rows = questions.where("title is not null").withColumn("kind", F.when(F.col("answer").rlike("[0-9]"), "number").otherwise("name"))
    rows = stash(rows, "questions")
    sizes = stash(rows.groupBy("title", "kind").agg(F.ceil(F.count("*") / block).cast("int").alias("_n")), "question-sizes")
    asked = rows.join(broadcast_if_small(sizes), ["title", "kind"])
    asked = asked.select(*rows.columns, F.pmod(F.xxhash64("paragraph_no"), F.col("_n")).cast("int").alias("_b"), F.lit(True).alias("_ask"))
    short = rows.where(F.length("answer") < most).select("title", "kind", "paragraph_no", "question_no", "id", "answer")
    short = short.join(broadcast_if_small(sizes), ["title", "kind"]).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    units = asked.unionByName(short.withColumn("_ask", F.lit(False)), allowMissingColumns=True)
    columns = rows.columns

    def pick(table: pa.Table) -> pa.Table:
        pool = table.filter(pc.invert(table["_ask"])).select(["paragraph_no", "question_no", "id", "answer"])
        answers = pool.sort_by([(c, "ascending") for c in ("paragraph_no", "question_no", "id")])["answer"].to_pylist()
        number: dict[str, int] = {}
        code = np.array([number.setdefault(a, len(number)) for a in answers], np.int64)
        brief, long = [], {}
        for a, n in number.items():
            (long.setdefault(a[:GRAM], []) if len(a) >= GRAM else brief).append((a, n))
        asks = table.filter(table["_ask"])
        others: list[str | None] = []
        for context, p, q in zip(*(asks[c].to_pylist() for c in ("context", "paragraph_no", "question_no"))):
            context, held = context or "", np.zeros(len(number), bool)
            grams = {context[i : i + GRAM] for i in range(len(context) - GRAM + 1)}
            for a, n in [*brief, *(x for g in long.keys() & grams for x in long[g])]:
                held[n] = a in context
            left = np.flatnonzero(~held[code])
            others.append(answers[left[(p * 7 + q * 13) % len(left)]] if len(left) else None)
        out = asks.select(columns).append_column("other", pa.array(others, pa.string()))
        return out.filter(pc.is_valid(out["other"]))

    schema = T.StructType([*rows.schema.fields, T.StructField("other", T.StringType())])
    return units.groupBy("title", "kind", "_b").applyInArrow(pick, schema)


def swap_pairs(questions: DataFrame, least: int = 40) -> DataFrame:
    """(id, title, context, kind, sentence, swapped): the first sentence of the paragraph that holds the answer, and the same
    sentence with the picked other answer in its place."""
    rows = swap_picks(questions)
    rows = rows.withColumn("sentence", F.get(F.filter(sentences(F.col("context")), lambda s: F.contains(s, F.col("answer"))), F.lit(0)))
    rows = rows.where(F.length("sentence") >= least)
    at = F.expr("locate(answer, sentence)")
    swapped = F.concat(F.substring("sentence", F.lit(1), at - 1), F.col("other"), F.substring("sentence", at + F.length("answer"), F.length("sentence")))
    return rows.select("id", "title", "context", "kind", "sentence", swapped.alias("swapped"))
