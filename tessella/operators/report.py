"""Listings, meters and reports over records, calls and settings: one DataFrame expression each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import normalized_name, trimmed
from tessella.operators.evaluate import matched_citations


def newest_first(rows: DataFrame, time: str, key: str, most: int | None = None) -> DataFrame:
    """Rows by descending time, ties by key; with most, the first ones only (each task keeps that many)."""
    ordered = rows.orderBy(F.desc(time), key)
    return ordered.limit(most) if most else ordered


def finished(records: DataFrame) -> DataFrame:
    """Records that are done, and those with feedback counted apart."""
    return records.where(F.col("phase") == "done").withColumn("has_feedback", F.col("feedback").isNotNull())


def runnable(configs: DataFrame, model_there: Column, retrieval_only: Column) -> DataFrame:
    """Selected configurations that can run: one that needs a model needs it to be there, and not only retrieval asked for."""
    return configs.where(F.col("selected") & (~F.col("needs_model") | (model_there & ~retrieval_only)))


def lab_grid(questions: DataFrame, configs: list[str]) -> DataFrame:
    """(config_id, query_id, question): each question under each configuration; the configurations are a short list."""
    return questions.select(F.explode(F.array(*map(F.lit, configs))).alias("config_id"), "query_id", "question")


def calls_per_question(rows: DataFrame) -> DataFrame:
    """rows (provider, judge, hyde, condense, corrective, follow_up, vanilla) with the calls base and worst."""
    extractive = F.col("provider") == "extractive"
    judge = F.when(F.col("judge") == "strict", 2).when(F.col("judge") == "combined", 1).otherwise(0)
    flag = lambda c: c.cast("int")
    base = 1 + judge + flag(F.col("hyde") & ~F.col("vanilla")) + flag(F.col("condense") & F.col("follow_up"))
    worst = base + F.when(F.col("corrective") & ~F.col("vanilla"), 2 + judge).otherwise(0)
    zero = lambda c: F.when(extractive, 0).otherwise(c)
    return rows.withColumns({"base": zero(base), "worst": zero(worst)})


def document_bytes(docs: DataFrame) -> DataFrame:
    """(doc_id, file, chunks, vectors, keywords, total) of docs (doc_id, size, has_file, chunk_bytes, embed_done, dim,
    keyword_bytes), and the library's totals in a row without an id."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    rows = docs.select(
        "doc_id",
        zero(F.when(F.col("has_file"), F.col("size"))).alias("file"),
        zero(F.col("chunk_bytes")).alias("chunks"),
        zero(F.when((F.col("embed_done") > 0) & (F.col("dim") > 0), F.col("embed_done") * (F.col("dim") + 4))).alias("vectors"),
        zero(F.col("keyword_bytes")).alias("keywords"),
    )
    rows = rows.withColumn("total", F.col("file") + F.col("chunks") + F.col("vectors") + F.col("keywords"))
    sums = [F.sum(c).alias(c) for c in ("file", "chunks", "vectors", "keywords", "total")]
    return rows.groupingSets([("doc_id",), ()], "doc_id").agg(*sums)


def generation_rates(rows: DataFrame, window: int) -> DataFrame:
    """rows (prompt_tokens, completion_tokens, latency_ms, extractive, finish) with tokens a second (null at 50 ms and
    below), whether the answer was cut off, and the share of the context window that the prompt takes."""
    timed = ~F.col("extractive") & (F.col("completion_tokens") > 0) & (F.col("latency_ms") > 50)
    return rows.withColumns({
        "tokens_per_sec": F.round(F.when(timed, F.col("completion_tokens") / (F.col("latency_ms") / 1000)), 6),
        "truncated": F.coalesce(F.col("finish") == "length", F.lit(False)),
        "window_share": F.round(F.least(F.lit(1.0), F.col("prompt_tokens") / F.lit(float(window))), 6),
    })


def embedding_progress(rows: DataFrame) -> DataFrame:
    """rows (done, total, seconds) with chunks a second and the seconds that are left."""
    rate = F.try_divide(F.col("done").cast("double"), F.col("seconds"))
    return rows.withColumns({"rate": F.round(rate, 6), "remaining": F.round(F.try_divide(F.col("total") - F.col("done"), rate), 6)})


def data_sent(calls: DataFrame) -> DataFrame:
    """(run_id, host, calls, prompt_tokens, cloud): what each run sent where."""
    local = F.col("host").rlike(r"^(?:localhost|127\.|\[?::1)")
    return calls.groupBy("run_id", "host").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.bool_or(~local).alias("cloud"))


def every_nth(rows: DataFrame, group: str, order: list[str], n: Column, most: int | None = None) -> DataFrame:
    """Of each group the rows 0, n, 2n, .. in the given order, at most ``most`` of them."""
    w = Window.partitionBy(group).orderBy(*order)
    rows = rows.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", n)
    kept = rows.where(F.col("_i") % F.col("_n") == 0)
    return (kept.where(F.col("_i") / F.col("_n") < most) if most else kept).drop("_i", "_n")


def suggested_questions(sections: DataFrame) -> DataFrame:
    """(doc_id, question): up to five of a document's section titles (doc_id, section, pos) of 4 to 69 characters, spread
    over the document, as questions."""
    titles = sections.where(F.length("section").between(4, 69)).groupBy("doc_id", "section").agg(F.min("pos").alias("pos"))
    titles = titles.withColumn("count", F.count("*").over(Window.partitionBy("doc_id")))
    step = F.greatest(F.lit(1), F.floor(F.col("count") / 5)).cast("int")
    some = every_nth(titles, "doc_id", ["pos", "section"], step, 5)
    plain = F.regexp_replace(F.regexp_replace("section", r"(?i)^(step|chapter|section)\s*[0-9]+[:.]?\s*", ""), "[:.]$", "")
    asked = F.when(trimmed(F.col("section")).endswith("?"), trimmed(F.col("section"))).otherwise(F.concat(F.lit("What does "), "doc_id", F.lit(" say about "), plain, F.lit("?")))
    return some.select("doc_id", "pos", asked.alias("question"))


def trend(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """(group, series): the values of each group in order; a session is a thread of a person's questions."""
    ordered = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_value"))))
    return rows.groupBy(group).agg(F.transform(ordered, lambda x: x["_value"]).alias("series"))


def waterfall(steps: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """steps with the share of the group's total that lies before each."""
    w = Window.partitionBy(group)
    before = F.sum(value).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return steps.withColumn("offset", F.round(F.coalesce(F.try_divide(before, F.sum(value).over(w)), F.lit(0.0)), 6))


def suite_averages(rows: DataFrame, value: str) -> DataFrame:
    """(config_id, kind, n, mean): by configuration and kind, and by configuration (kind null)."""
    found = rows.groupingSets([("config_id",), ("config_id", "kind")], "config_id", "kind")
    return found.agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"))


def speed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """(step, before, after, factor) of mean times that both sides have; how many times as fast the second is."""
    mean = lambda rows, name: rows.groupBy("step").agg(F.avg("ms").alias(name))
    rows = mean(before, "before").join(mean(after, "after"), "step")
    return rows.select("step", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), F.round(F.try_divide("before", "after"), 6).alias("factor"))


def better(change: DataFrame) -> DataFrame:
    """Rows (n, mean_change, low, high) with better: the interval, rounded to three places, lies above zero."""
    return change.withColumn("better", F.round("low", 3) > 0)


def model_rows(parts: DataFrame) -> DataFrame:
    """(model, first_token, reading, memory) of rows (model, part, value, memory), one a part; models without a speed part
    are left out."""
    of = lambda part: F.max(F.when(F.col("part") == part, F.col("value")))
    rows = parts.groupBy("model").agg(of("speed").alias("first_token"), of("reading").alias("reading"), F.max("memory").alias("memory"))
    return rows.where("first_token is not null").orderBy("first_token", "model")


def resolve_citations(cites: DataFrame, sources: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, name, page, doc_id, hits): where a clicked citation leads: the best source it points at, else a document
    whose name begins like it, else the first source's document, else the library's first. docs are (doc_id, doc_name) and, where
    their order isn't that of their ids, pos."""
    cites = cites.withColumn("k", normalized_name(F.col("name")))
    hit = matched_citations(cites, sources).groupBy("query_id", "k", "page").agg(F.min_by("doc_id", F.struct("rank", "doc_id")).alias("hit"), F.count("*").alias("hits"))
    # equal beginnings are found by an equi join on each length that a name has
    place = F.struct("pos", "doc_id") if "pos" in docs.columns else F.struct("doc_id")
    head = docs.agg(F.min_by("doc_id", place).alias("head"))  # one row
    named = docs.select(F.col("doc_id").alias("d"), place.alias("o"), normalized_name(F.col("doc_name")).alias("dk")).where("dk <> ''")
    starts = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.substring(c, F.lit(1), n)))
    own = cites.select("k").where("k <> ''").distinct()
    shorter = own.select("k", starts(F.col("k")).alias("dk")).join(named, "dk").select("k", "d", "o")
    longer = named.select("d", "o", starts(F.col("dk")).alias("k")).join(own, "k").select("k", "d", "o")
    name = shorter.unionByName(longer).groupBy("k").agg(F.min_by("d", "o").alias("by_name"))
    first = sources.groupBy("query_id").agg(F.min_by("doc_id", F.struct("rank", "doc_id")).alias("first"))
    rows = cites.join(hit, ["query_id", "k", "page"], "left").join(name, "k", "left").join(first, "query_id", "left").crossJoin(F.broadcast(head))
    return rows.select("query_id", "name", "page", F.coalesce("hit", "by_name", "first", "head").alias("doc_id"), F.coalesce("hits", F.lit(0)).alias("hits"))
