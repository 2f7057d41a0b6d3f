"""Extractive answers and context compaction: greedy passes over a query's few sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import re

import pyarrow as pa

from tessella.functions.citations import FALLBACK
from tessella.functions.text import bigrams, estimate_tokens, sentences, source_label, tokens

#: Fixed value: words by which a sentence goes on from the one before.
CONTINUES = re.compile(r"^(?:it|he|she|they|this|these|those|his|her|its|their|there|such|both|the latter|the former)\b", re.I)


def sentence_rows(sources: DataFrame, squeeze: bool = True) -> DataFrame:
    """(query_id, rank, label, score, pos, sentence, next, terms) of the sources' sentences in order."""
    parts = sentences(F.col("text"))
    if squeeze:
        parts = F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    rows = sources.select("query_id", "rank", source_label(F.col("doc_name"), F.col("page")).alias("label"), "score", parts.alias("ss"))
    rows = rows.select("query_id", "rank", "label", "score", "ss", F.posexplode("ss").alias("pos", "sentence"))
    return rows.select("query_id", "rank", "label", "score", "pos", "sentence", F.get("ss", F.col("pos") + 1).alias("next"), tokens(F.col("sentence")).alias("terms"))


def scored_sentences(sources: DataFrame, queries: DataFrame, idf: DataFrame | None = None) -> DataFrame:
    """Sentences of 40 to 420 characters and four tokens that hold a question term, with their score."""
    words = queries.select("query_id", tokens(F.col("question")).alias("q"))
    asked = words.select("query_id", F.explode(F.array_distinct("q")).alias("term"))
    weighted = asked.join(idf, "term", "left") if idf is not None else asked.withColumn("idf", F.lit(1.0))
    weighted = weighted.withColumn("w", F.coalesce("idf", F.lit(1.0)))
    weights = weighted.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("ws"), F.sum("w").alias("mass"))
    rows = sentence_rows(sources.where(~F.coalesce("neighbor", F.lit(False))))
    rows = rows.where(F.length("sentence").between(40, 420) & (F.size("terms") >= 4))
    rows = rows.join(weights, "query_id").join(words, "query_id")
    best = sources.groupBy("query_id").agg(F.greatest(F.max(F.coalesce("score", F.lit(0.0))), F.lit(1e-9)).alias("top"))
    rows = rows.join(best, "query_id").withColumn("set", F.array_distinct("terms"))
    hits = F.filter("ws", lambda x: F.array_contains("set", x["term"]))
    covered = F.aggregate(hits, F.lit(0.0), lambda a, x: a + x["w"]) / F.when(F.col("mass") == 0, 1.0).otherwise(F.col("mass"))
    relevance = F.sqrt(F.greatest(F.lit(0.0), F.coalesce("score", F.lit(0.0))) / F.col("top"))
    asked_pairs = bigrams(F.col("q"))
    pairs = F.when(F.size(asked_pairs) > 0, F.size(F.array_intersect(bigrams(F.col("terms")), asked_pairs)) / F.size(asked_pairs)).otherwise(0.0)
    score = covered / F.pow(F.size("set"), F.lit(0.25)) * (0.3 + 0.7 * relevance) * (1 + 0.3 * pairs)
    follow = F.when(F.length("next") < 300, F.col("next"))
    return rows.where(F.size(hits) > 0).select("query_id", "rank", "pos", "label", "sentence", follow.alias("next"), "set", F.round(score, 9).alias("score"))


def extractive_answer(sources: DataFrame, queries: DataFrame, idf: DataFrame | None = None, most: int = 8, cut: float = 0.5, same: float = 0.7) -> DataFrame:
    """(query_id, answer, bullets, labels): the best sentences, each with its citation, or the fallback reply.

    Scoring is DataFrame work; the greedy choice sees the few scored sentences of one query at a time."""

    def choose(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (-r["score"], r["rank"], r["pos"]))
        chosen, used = [], set()
        for r in rows:
            if len(chosen) >= most or r["score"] < rows[0]["score"] * cut:
                break
            own = set(r["set"])
            if (r["rank"], r["pos"]) in used or any(len(own & c[0]) / len(own) > same for c in chosen):
                continue
            text = r["sentence"]
            if r["next"] and (CONTINUES.match(r["next"]) or len(text) < 90):
                used.add((r["rank"], r["pos"] + 1))
                text = f"{text} {r['next']}"
            chosen.append((own, text, r["label"]))
        labels = "; ".join(dict.fromkeys(c[2] for c in chosen))
        bullets = "\n".join(f"- {text} [{label}]" for _, text, label in chosen)
        answer = f"**Key passages from the documents**\n{bullets}\n\nSources: [{labels}]"
        return pa.table({"query_id": table["query_id"][:1], "answer": [answer], "bullets": pa.array([len(chosen)], pa.int32()), "labels": [labels]})

    kind = queries.schema["query_id"].dataType.simpleString()
    found = scored_sentences(sources, queries, idf).groupBy("query_id").applyInArrow(choose, f"query_id {kind}, answer string, bullets int, labels string")
    rows = queries.select("query_id").join(found, "query_id", "left")
    return rows.select("query_id", F.coalesce("answer", F.lit(FALLBACK)).alias("answer"), F.coalesce("bullets", F.lit(0)).alias("bullets"), F.coalesce("labels", F.lit("")).alias("labels"))


def _tokens(text: str) -> int:
    return max(int(len(text) / 4 + 0.5), int(len(re.split(r"\s+", text.strip())) * 1.25 + 0.5)) if text else 0


def compact_context(sources: DataFrame, queries: DataFrame, idf: DataFrame | None = None, share: float = 0.6, least: int = 60) -> DataFrame:
    """(query_id, rank, text, tokens, compacted): each passage keeps its best sentences and the one after each within a
    share of its tokens; a sentence that an earlier passage kept is left out; gaps are marked."""
    words = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("question")))).alias("term"))
    words = words.join(idf, "term", "left") if idf is not None else words.withColumn("idf", F.lit(1.0))
    weights = words.groupBy("query_id").agg(F.collect_list(F.struct("term", F.coalesce("idf", F.lit(1.0)).alias("w"))).alias("ws"))
    rows = sources.withColumn("ss", F.transform(sentences(F.col("text")), lambda s: F.struct(s.alias("s"), tokens(s).alias("t"))))
    rows = rows.withColumn("n", F.coalesce("tokens", estimate_tokens(F.col("text")))).join(weights, "query_id", "left")
    score = lambda s: F.aggregate("ws", F.lit(0.0), lambda a, x: a + F.when(F.array_contains(s["t"], x["term"]), x["w"]).otherwise(0.0))
    rows = rows.select("query_id", "rank", "text", "n", F.transform("ss", lambda s: F.struct(s["s"].alias("s"), F.coalesce(F.round(score(s), 9), F.lit(0.0)).alias("w"))).alias("ss"))

    def compact(table: pa.Table) -> pa.Table:
        seen, out = set(), []
        plain = lambda s: " ".join(s.split()).lower()
        for r in sorted(table.to_pylist(), key=lambda r: r["rank"]):
            parts = [x["s"] for x in r["ss"]]
            if len(parts) <= 2:
                seen |= set(map(plain, parts))
                out.append((r["query_id"], r["rank"], r["text"], r["n"], False))
                continue
            keep, used = set(), 0
            for i in sorted(range(len(parts)), key=lambda i: (-r["ss"][i]["w"], i)):
                if used >= max(least, r["n"] * share):
                    break
                for j in (i, i + 1):
                    if j < len(parts) and j not in keep and plain(parts[j]) not in seen:
                        keep.add(j)
                        used += _tokens(parts[j])
            kept = sorted(keep)
            seen |= {plain(parts[j]) for j in kept}
            text = " ".join(("… " if n and j != kept[n - 1] + 1 else "") + parts[j] for n, j in enumerate(kept))
            out.append((r["query_id"], r["rank"], text, _tokens(text), True))
        columns = list(zip(*out))
        return pa.table([pa.array(columns[0], table.schema.field("query_id").type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int32()), pa.array(columns[4])], ["query_id", "rank", "text", "tokens", "compacted"])

    kind = queries.schema["query_id"].dataType.simpleString()
    return rows.groupBy("query_id").applyInArrow(compact, f"query_id {kind}, rank int, text string, tokens int, compacted boolean")
