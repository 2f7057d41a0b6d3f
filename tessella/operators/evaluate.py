"""Checks of answers without a model: citations, claim support, coverage, confidence, retrieval accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import citations as C
from tessella.functions.text import normalized_name, sentences, tokens

THRESHOLD, CITE_MIN, CONFLICT_MIN = 0.6, 0.3, 0.5


def citation_rows(answers: DataFrame) -> DataFrame:
    """(query_id, name, page): distinct citations of each answer by normalised name and page."""
    rows = answers.select("query_id", F.explode(C.parse_citations(F.col("answer"))).alias("c")).select("query_id", "c.name", "c.page")
    return rows.groupBy("query_id", normalized_name(F.col("name")).alias("k"), "page").agg(F.min("name").alias("name"))


def single_document(sources: DataFrame) -> DataFrame:
    return sources.groupBy("query_id").agg((F.count_distinct("doc_id") <= 1).alias("single"))


def matched_citations(cites: DataFrame, sources: DataFrame) -> DataFrame:
    """Citations joined with the sources they point at: an equi join on query and page, then the name rule."""
    source = sources.select("query_id", F.col("page"), "doc_id", "doc_name", F.col("rank"), "neighbor")
    rows = cites.join(source, ["query_id", "page"]).join(single_document(sources), "query_id")
    return rows.where(C.cite_matches(F.col("name"), F.col("page"), F.col("doc_name"), F.col("page"), F.col("single")))


def citation_check(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Per query: distinct, valid and invalid citations, precision, and the share of claims that cite."""
    cites = citation_rows(answers)
    valid = matched_citations(cites, sources).select("query_id", "k", "page").distinct().withColumn("ok", F.lit(1))
    counts = cites.join(valid, ["query_id", "k", "page"], "left").groupBy("query_id").agg(F.count("*").alias("cited"), F.count("ok").alias("valid"))
    claims = F.filter(sentences(F.col("answer")), C.is_claim)
    own = answers.select("query_id", F.size(claims).alias("claims"), F.size(F.filter(claims, lambda s: F.size(C.parse_citations(s)) > 0)).alias("citing"))
    rows = own.join(counts, "query_id", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("cited", "valid")})
    return rows.select(
        "query_id",
        "cited",
        "valid",
        (F.col("cited") - F.col("valid")).alias("invalid"),
        F.round(F.try_divide("valid", "cited"), 6).alias("precision"),
        F.round(F.coalesce(F.try_divide("citing", "claims"), F.lit(0.0)), 6).alias("coverage"),
    )


def claim_overlap(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """(query_id, claim_no, ratio, best_doc, best_page): best share of a claim's words that one source holds."""
    words = claims.select("query_id", "claim_no", F.array_distinct("terms").alias("c")).where(F.size("c") > 0)
    total = words.select("query_id", "claim_no", F.size("c").alias("n"))
    flat = words.select("query_id", "claim_no", F.explode("c").alias("term"))
    held = sources.select("query_id", "doc_id", "idx", "page", F.explode(F.array_distinct("terms")).alias("term"))
    hits = flat.join(held, ["query_id", "term"]).groupBy("query_id", "claim_no", "doc_id", "idx", "page").agg(F.count("*").alias("hits"))
    best = hits.groupBy("query_id", "claim_no").agg(F.max(F.struct("hits", (-F.col("idx")).alias("i"), "doc_id", "page")).alias("b"))
    return total.join(best, ["query_id", "claim_no"], "left").select(
        "query_id", "claim_no", F.round(F.coalesce(F.col("b.hits"), F.lit(0)) / F.col("n"), 6).alias("ratio"), F.col("b.doc_id").alias("best_doc"), F.col("b.page").alias("best_page")
    )


def claim_support(answers: DataFrame, sources: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(query_id, claim_no, text, plain, ratio, cited_ratio, misattributed, missing, conflict, status) of each claim.

    A query's sources are few (its k and their neighbours), so they travel with it as one array."""
    source = sources.select(
        "query_id", F.struct("rank", "doc_id", "doc_name", "page", F.coalesce("text", F.lit("")).alias("text"), F.array_distinct(tokens(F.col("text"))).alias("set")).alias("s")
    )
    source = source.groupBy("query_id").agg(F.sort_array(F.collect_list("s")).alias("ss"))
    text = F.array_join(F.transform("ss", lambda s: s["text"]), " ")
    source = source.withColumns({
        "pooled": F.array_distinct(F.flatten(F.transform("ss", lambda s: s["set"]))),
        "numbers": C.numbers_of(text),
        "names": C.name_words(text),
        "single": F.size(F.array_distinct(F.transform("ss", lambda s: s["doc_id"]))) <= 1,
        "lines": F.flatten(F.transform("ss", lambda s: F.transform(sentences(s["text"]), lambda t: F.struct(t.alias("t"), F.array_distinct(tokens(t)).alias("set"))))),
    })
    claims = answers.select("query_id", F.posexplode(F.filter(sentences(F.col("answer")), C.is_claim)).alias("claim_no", "text"))
    claims = claims.withColumn("plain", C.plain_claim(F.col("text"))).withColumn("toks", F.array_distinct(tokens(F.col("plain"))))
    rows = claims.join(source, "query_id", "left")
    n = F.greatest(F.size("toks"), F.lit(1))
    share = lambda s: F.size(F.array_intersect(F.col("toks"), s)) / n
    none = F.array().cast("array<double>")
    rows = rows.withColumn("best", F.coalesce(F.array_max(F.coalesce(F.transform("ss", lambda s: share(s["set"])), none)), F.lit(0.0)))
    rows = rows.withColumn("ratio", F.greatest("best", F.coalesce(share(F.col("pooled")), F.lit(0.0)) * 0.9))
    cites = C.parse_citations(F.col("text"))
    pointed = lambda s: F.exists(cites, lambda c: C.cite_matches(c["name"], c["page"], s["doc_name"], s["page"], F.col("single")))
    rows = rows.withColumn("cited_ratio", F.array_max(F.transform(F.filter("ss", pointed), lambda s: share(s["set"]))))
    absent = F.filter(C.numbers_of(F.col("plain"), True), lambda x: ~F.array_contains("numbers", x))
    unknown = F.filter(C.names_of(F.col("plain")), lambda x: ~F.array_contains("names", x) & ~F.array_contains("names", F.regexp_replace(x, r"\d+$", "")))
    rows = rows.withColumn("missing", F.coalesce(F.concat(absent, unknown), F.array().cast("array<string>")))
    first = F.when(F.col("ratio") >= threshold, "supported").when(F.col("ratio") >= threshold / 2, "partial").otherwise("unsupported")
    rows = rows.withColumn("first", first)
    # the sentence that shares most words with the claim, the first of equals
    scored = F.transform("lines", lambda x, i: F.struct(share(x["set"]).alias("r"), (-i).alias("i"), x["t"].alias("t")))
    rows = rows.withColumn("match", F.when(F.col("first") == "supported", F.array_max(scored)))
    differ = F.col("plain").rlike(C.NEGATION) != F.col("match.t").rlike(C.NEGATION)
    against = C.direction(F.col("plain")) * C.direction(F.col("match.t")) < 0
    rows = rows.withColumn("conflict", F.when(F.col("match.r") >= CONFLICT_MIN, F.when(differ, "negation").when(against, "direction")))
    lost = F.size("missing")
    status = F.when(lost >= 2, "unsupported").when(((lost == 1) | F.col("conflict").isNotNull()) & (F.col("first") == "supported"), "partial").otherwise(F.col("first"))
    return rows.select(
        "query_id",
        "claim_no",
        "text",
        F.trim(F.regexp_replace("plain", r"\s+([.,;])", "$1")).alias("plain"),
        F.round("ratio", 6).alias("ratio"),
        F.round("cited_ratio", 6).alias("cited_ratio"),
        F.coalesce((F.col("cited_ratio") < CITE_MIN) & (F.col("best") >= threshold), F.lit(False)).alias("misattributed"),
        "missing",
        "conflict",
        status.alias("status"),
    )


def support_summary(claims: DataFrame) -> DataFrame:
    """Per query: claims, share supported, score 1 to 5, citation accuracy, misattributed claims."""
    good = F.count_if(F.col("status") == "supported") + 0.5 * F.count_if(F.col("status") == "partial")
    share = good / F.count("*")
    return claims.groupBy("query_id").agg(
        F.count("*").alias("claims"),
        F.round(share, 6).alias("share"),
        F.round(1 + 4 * share, 6).alias("score"),
        F.round(F.avg(F.when(F.col("cited_ratio").isNotNull(), (F.col("cited_ratio") >= CITE_MIN).cast("int"))), 6).alias("citation_accuracy"),
        F.count_if("misattributed").alias("misattributed"),
        F.count_if(F.col("status") == "unsupported").alias("unsupported"),
    )


def question_coverage(question: Column, answer: Column) -> Column:
    """Share of the question's distinct words that the answer holds; null without words."""
    q = F.array_distinct(tokens(question))
    return F.try_divide(F.size(F.array_intersect(q, tokens(answer))), F.size(q))


def context_utilization(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(query_id, utilization): share of the primary sources that the answer cites."""
    primary = sources.where(~F.col("neighbor"))
    hit = matched_citations(citation_rows(answers), sources).where(~F.col("neighbor")).select("query_id", "doc_id", "rank").distinct().withColumn("hit", F.lit(1))
    rows = primary.join(hit, ["query_id", "doc_id", "rank"], "left")
    return rows.groupBy("query_id").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("utilization"))


def confidence(rows: DataFrame) -> DataFrame:
    """(query_id, level, score, reasons) from the signals that are there: groundedness, context_relevance, relevance (judge,
    1 to 5 or null), claims, share, citation_accuracy, unsupported, misattributed, precision, invalid, coverage, fallback
    and cosine (largest, null if a source has none)."""
    accuracy = F.coalesce("citation_accuracy", F.lit(1.0))
    parts = [
        (F.col("groundedness") / 5, 0.35),
        (F.when(F.col("claims") > 0, F.col("share")), 0.3),
        (F.col("precision") * accuracy, 0.15),
        (F.col("context_relevance") / 5, 0.1),
        (F.coalesce(F.col("relevance") / 5, F.col("coverage")), 0.1),
    ]
    weight, total = F.lit(0.0), F.lit(0.0)
    for value, w in parts:
        weight = weight + F.when(value.isNotNull(), w).otherwise(0.0)
        total = total + F.coalesce(value * w, F.lit(0.0))
    score = F.when(F.col("fallback"), 0.0).otherwise(F.round(total / F.when(weight == 0, 1.0).otherwise(weight), 6))
    say = lambda when, text: F.when(when, text)
    reasons = F.array(
        say(F.col("precision").isNull(), F.lit("The answer cites nothing.")),
        say(F.col("unsupported") > 0, F.concat(F.col("unsupported").cast("string"), F.lit(" claim(s) have no support in the sources."))),
        say(F.col("invalid") > 0, F.concat(F.col("invalid").cast("string"), F.lit(" citation(s) name a page that is no source."))),
        say(F.col("misattributed") > 0, F.concat(F.col("misattributed").cast("string"), F.lit(" claim(s) cite a source without their content."))),
        say(F.col("groundedness") <= 3, F.concat(F.lit("The judge's groundedness is "), F.col("groundedness").cast("string"), F.lit(" of 5."))),
        say(F.col("cosine") < 0.75, F.lit("No source is close to the question.")),
    )
    reasons = F.when(F.col("fallback"), F.array(F.lit("No answer was found in the sources."))).otherwise(F.filter(reasons, lambda r: r.isNotNull()))
    level = F.when(F.col("fallback"), "Low").when(score >= 0.8, "High").when(score >= 0.6, "Medium").otherwise("Low")
    return rows.select("query_id", level.alias("level"), score.alias("score"), reasons.alias("reasons"))


def is_fallback(answer: Column) -> Column:
    """The answer holds the beginning of the fallback reply."""
    return F.lower(F.coalesce(answer, F.lit(""))).contains(C.FALLBACK.lower()[:50])


def needs_correction(fallback: Column, groundedness: Column, share: Column) -> Column:
    """An answer is tried again after the fallback reply, a judge score up to 3, or support below a half (no claim: none)."""
    return fallback | F.coalesce(groundedness <= 3, F.lit(False)) | (F.coalesce(share, F.lit(0.0)) < 0.5)


def better_attempt(first: DataFrame, second: DataFrame) -> DataFrame:
    """Of two attempts (query_id, attempt, quality, ...) the second, where its quality isn't lower."""
    order = Window.partitionBy("query_id").orderBy(F.desc("quality"), F.desc("attempt"))
    return first.unionByName(second).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def retrieval_accuracy(sources: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, hit, recall, rr, first_rank) of expected pages (query_id, name, page) among primary sources."""
    primary = sources.where(~F.col("neighbor"))
    want = expected.groupBy("query_id").agg(F.count("*").alias("n"))
    rows = matched_citations(expected.withColumn("e", F.monotonically_increasing_id()), primary)
    found = rows.groupBy("query_id").agg(F.min("rank").alias("first_rank"), F.count_distinct("e").alias("found"))
    out = want.join(found, "query_id", "left")
    return out.select(
        "query_id",
        F.col("first_rank").isNotNull().cast("int").alias("hit"),
        F.round(F.coalesce("found", F.lit(0)) / F.col("n"), 6).alias("recall"),
        F.round(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), 6).alias("rr"),
        "first_rank",
    )
