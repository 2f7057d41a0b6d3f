"""Batches of questions, from the search to the confidence of the answer.

An attempt searches, picks sources, answers and evaluates all its questions in stages; each stage's table is written to
the shared folder, so a lost executor costs one stage. Weak answers, and only those, get a second, wider attempt; the better
one stays. Models (answers, judges, rewriting, a made-up passage to search by) are tables that the caller's functions make
of the questions; without them answers are extracted from the sources.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import answer, evaluate, measure, retrieve
from tessella.operators.index import KEYS, top
from tessella.operators.retrieve import RetrievalConfig
from tessella.sources.stash import stash

#: Fixed value: words by which a question points back.
REFERS = r"(?i)\b(?:it|this|that|they|them|those|these|its|their|the same|above)\b"
#: What is known of each attempt's answer.
SIGNALS = ("claims", "share", "score", "citation_accuracy", "misattributed", "unsupported", "cited", "valid", "invalid", "precision", "citing", "coverage", "utilization", "fallback", "groundedness", "relevance", "context_relevance", "cosine")
Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Library:
    """What is searched. chunks: doc_id, doc_name, idx, page, section, tokens, without texts; texts adds ``text`` to rows of
    chunks. keyword and semantic give the ranked list (query_id, doc_id, idx, score, rank) of k chunks for questions (query_id,
    question). ready of documents have vectors."""

    chunks: DataFrame
    texts: Step
    keyword: Callable[[DataFrame, int], DataFrame]
    semantic: Callable[[DataFrame, int], DataFrame] | None = None
    vectors: DataFrame | None = None
    idf: DataFrame | None = None
    documents: int = 1
    ready: int = 1


@dataclass(frozen=True)
class Models:
    """Functions from a table of questions to one with a further column: answer (of query_id, question, context), judge (of
    query_id, question, context, answer: groundedness, relevance, context_relevance), rewrite (search), passage, rerank (of
    query_id, question, doc_id, idx, text: rerank_score)."""

    answer: Step | None = None
    judge: Step | None = None
    rewrite: Step | None = None
    passage: Step | None = None
    rerank: Step | None = None


@dataclass(frozen=True)
class RunConfig:
    retrieval: RetrievalConfig = field(default_factory=RetrievalConfig)
    corrective: bool = True
    compact_share: float | None = None
    retrieval_only: bool = False


@dataclass(frozen=True)
class Run:
    """records: one row a question; sources and trace (stage, rank, doc_id, idx, score) of all attempts; stages: questions
    and rows of each stage."""

    records: DataFrame
    sources: DataFrame
    trace: DataFrame
    stages: DataFrame


def standalone_question(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, standalone) of user turns (conv_id, turn, question): a short question that points back gets the one
    before it in front."""
    before = F.lag("question").over(Window.partitionBy("conv_id").orderBy("turn"))
    short = F.size(F.split("question", r"[ \t\n\x0b\f\r]+")) < 12
    refers = before.isNotNull() & short & F.col("question").rlike(REFERS)
    return rows.select("conv_id", "turn", F.when(refers, F.concat(before, F.lit(" "), "question")).otherwise(F.col("question")).alias("standalone"))


def recent_history(rows: DataFrame, n: int = 2, most: int = 600) -> DataFrame:
    """The last n answered turns (conv_id, turn, question, answer, error) of each conversation, errors left out, answers cut."""
    good = rows.where("answer <> '' AND error IS NULL")
    last = good.withColumn("_r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("_r") <= n)
    cut = F.when(F.length("answer") > most, F.concat(F.substring("answer", 1, most), F.lit("…"))).otherwise(F.col("answer"))
    return last.select("conv_id", "turn", "question", cut.alias("answer"))


def attempt(library: Library, asked: DataFrame, config: RunConfig, models: Models, number: int) -> Run:
    """One attempt at questions (query_id, question, search): each stage is a written table."""
    c, keep = config.retrieval, {}

    def stage(name: str, rows: DataFrame) -> DataFrame:
        keep[name] = stash(rows, f"ask-{name}")
        return keep[name]

    asked = stage("questions", asked)
    searched = asked.select("query_id", F.col("search").alias("question"))
    keyword = stage("bm25", library.keyword(searched, c.pool))
    semantic = None
    if library.semantic is not None and c.mode != "bm25":
        meant = searched
        if models.passage:
            meant = models.passage(asked).select("query_id", "passage").join(searched, "query_id", "right")
            meant = stage("passage", meant.select("query_id", F.concat_ws("\n", "question", "passage").alias("question")))
        semantic = stage("semantic", library.semantic(meant, c.pool))
    fused = stage("fused", top(retrieve.fused_list(keyword, semantic, c, library.vectors), max(c.k, c.fetch_k)))
    reranked = None
    if c.rerank and models.rerank:
        candidates = library.texts(fused.select("query_id", *KEYS).join(library.chunks.drop("doc_name"), list(KEYS)))
        scored = models.rerank(candidates.join(asked.select("query_id", "question"), "query_id").select("query_id", "question", *KEYS, "text"))
        reranked = stage("reranked", scored.select("query_id", *KEYS, "rerank_score"))
    chosen = retrieve.choose(fused, library.chunks, c, reranked)
    sources = stage("sources", library.texts(chosen))
    mode = retrieve.effective_mode(c.mode, F.lit(library.ready if semantic is not None else 0), F.lit(library.documents))
    sizes = sources.groupBy("query_id").agg(F.count("*").alias("n_sources"))
    records = asked.join(sizes, "query_id", "left").withColumns({"n_sources": F.coalesce("n_sources", F.lit(0)), "attempt": F.lit(number), "k": F.lit(c.k), "effective_mode": mode})
    if not config.retrieval_only:
        records = records.join(_answered(library, asked, sources, semantic, config, models, stage), "query_id", "left").withColumn("quality", quality())
    records = stage("records", records)
    lists = {n: keep[n] for n in ("semantic", "bm25", "fused") if n in keep} | {"sources": sources.where("not neighbor")}
    if reranked is not None:
        lists["reranked"] = top(reranked.select("query_id", *KEYS, F.col("rerank_score").alias("score")), c.fetch_k)
    parts = [t.where("rank <= 10").select("query_id", F.lit(n).alias("stage"), F.col("rank").cast("int").alias("rank"), *KEYS, F.col("score").cast("double").alias("score")) for n, t in lists.items()]
    counts = [t.select(F.lit(n).alias("stage"), "query_id").groupBy("stage").agg(F.count_distinct("query_id").alias("questions"), F.count("*").alias("rows")) for n, t in keep.items()]
    tagged = lambda rows: rows.withColumn("attempt", F.lit(number))
    return Run(records, tagged(sources), tagged(_union(parts)), tagged(_union(counts)))


def _answered(library: Library, asked: DataFrame, sources: DataFrame, semantic: DataFrame | None, config: RunConfig, models: Models, stage: Callable) -> DataFrame:
    """(query_id, context_tokens, answer, SIGNALS..) of the sources that an attempt found."""
    shown = sources
    if config.compact_share is not None:
        place = F.coalesce("rank", F.col("neighbor_of") + F.lit(1000))  # neighbours come after the chosen
        short = answer.compact_context(sources.withColumn("rank", place), asked, library.idf, config.compact_share)
        short = short.select("query_id", F.col("rank").alias("_r"), F.col("text").alias("_t"), F.col("tokens").alias("_n"))
        shown = sources.withColumn("_r", place).join(short, ["query_id", "_r"], "left").withColumns({"text": F.coalesce("_t", "text"), "tokens": F.coalesce("_n", "tokens")})
        shown = stage("compacted", shown.drop("_r", "_t", "_n"))
    context = stage("context", asked.join(retrieve.format_context(shown), "query_id", "left"))
    if models.answer:
        answers = models.answer(context.select("query_id", "question", "context")).select("query_id", "answer")
    else:
        answers = answer.extractive_answer(sources, asked, library.idf).select("query_id", "answer")
    answers = stage("answers", answers)
    judged = stage("judged", models.judge(context.select("query_id", "question", "context").join(answers, "query_id"))) if models.judge else None
    signals = evaluate_answers(asked, answers, shown, judged, semantic)
    told = context.select("query_id", F.coalesce("context_tokens", F.lit(0)).alias("context_tokens"))
    return told.join(answers, "query_id", "left").join(signals, "query_id", "left")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def evaluate_answers(asked: DataFrame, answers: DataFrame, sources: DataFrame, judged: DataFrame | None = None, semantic: DataFrame | None = None) -> DataFrame:
    """(query_id, SIGNALS..): everything that is known of the answers without a person: claim support, citations, coverage
    of the question, use of the sources, the fallback reply, a judge's scores and the best source's cosine (1 where a source
    has none)."""
    both = asked.select("query_id", "question").join(answers, "query_id", "left")
    own = both.select("query_id", F.round(evaluate.question_coverage(F.col("question"), F.col("answer")), 6).alias("coverage"), evaluate.is_fallback(F.col("answer")).alias("fallback"))
    cites = evaluate.citation_check(answers, sources).withColumnRenamed("coverage", "citing")
    support = evaluate.support_summary(evaluate.claim_support(answers, sources))
    used = evaluate.context_utilization(answers, sources)
    rows = own.join(support, "query_id", "left").join(cites, "query_id", "left").join(used, "query_id", "left")
    if judged is not None:
        rows = rows.join(judged.select("query_id", "groundedness", "relevance", "context_relevance"), "query_id", "left")
    else:
        rows = rows.withColumns({c: F.lit(None).cast("int") for c in ("groundedness", "relevance", "context_relevance")})
    if semantic is not None:
        near = sources.select("query_id", *KEYS).join(semantic.select("query_id", *KEYS, F.col("score").alias("_c")), ["query_id", *KEYS], "left")
        rows = rows.join(near.groupBy("query_id").agg(F.max(F.coalesce("_c", F.lit(1.0))).alias("cosine")), "query_id", "left")
    else:
        rows = rows.withColumn("cosine", F.lit(None).cast("double"))
    return rows.withColumn("claims", F.coalesce("claims", F.lit(0))).select("query_id", *SIGNALS)


def quality() -> Column:
    """By which attempts are compared: the judge's groundedness, else the support score, else 0; 2 less for a fallback."""
    return F.coalesce(F.col("groundedness").cast("double"), F.col("score"), F.lit(0.0)) - F.when(F.col("fallback"), 2.0).otherwise(0.0)


def corrective_retry(first: DataFrame, again: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """first with attempts (1 or 2) and attempt (the one that stays). Only the questions whose answer is weak reach ``again``,
    whose rows have the same columns; a second answer stays where its quality isn't lower."""
    weak = stash(first.where(evaluate.needs_correction(F.col("fallback"), F.col("groundedness"), F.col("share"))).select("query_id"), "weak")
    marked = lambda rows, n: rows.withColumn("attempt", F.lit(n))
    tried = evaluate.better_attempt(marked(first.join(weak, "query_id", "left_semi"), 1), marked(again(weak), 2))
    rest = marked(first.join(weak, "query_id", "left_anti"), 1)
    return rest.withColumn("attempts", F.lit(1)).unionByName(tried.withColumn("attempts", F.lit(2)))


def run_questions(library: Library, questions: DataFrame, config: RunConfig = RunConfig(), models: Models = Models()) -> Run:
    """questions (query_id, question, and search: the stand-alone form, where there is one) from the search to the confidence."""
    asked = questions if "search" in questions.columns else questions.withColumn("search", F.col("question"))
    runs = [attempt(library, asked.select("query_id", "question", "search"), config, models, 1)]

    def again(weak: DataFrame) -> DataFrame:
        rows = runs[0].records.join(weak, "query_id", "left_semi").select("query_id", "question", "search")
        if models.rewrite:
            new = models.rewrite(rows).select("query_id", F.col("search").alias("_new"))
            rows = rows.join(new, "query_id", "left").withColumn("search", F.coalesce(F.nullif("_new", F.lit("")), "search")).drop("_new")
        wider = replace(config, retrieval=replace(config.retrieval, k=config.retrieval.k + 2, mode="hybrid"))
        runs.append(attempt(library, rows, wider, models, 2))
        return runs[1].records

    first = runs[0].records
    if config.retrieval_only:
        return replace(runs[0], records=first.withColumn("phase", F.lit("done")))
    if config.corrective:
        kept = corrective_retry(first.drop("attempt"), lambda weak: again(weak).drop("attempt"))
    else:
        kept = first.withColumn("attempts", F.lit(1))
    kept = stash(kept, "ask-kept")
    sure = evaluate.confidence(kept.select("query_id", *SIGNALS)).select("query_id", "level", F.col("score").alias("confidence"), "reasons")
    records = kept.join(sure, "query_id").withColumn("phase", F.lit("done"))
    return Run(records, _union([r.sources for r in runs]), _union([r.trace for r in runs]), _union([r.stages for r in runs]))


def session_dashboard(records: DataFrame, steps: list[str]) -> DataFrame:
    """One row a session of its finished records (session_id, phase, total_ms, truncated, groundedness, claims, share, level,
    feedback, and a time in ms for each step): answers, truncated, nearest-rank latencies, mean groundedness and claim support
    in percent (answers without claims skipped), counts of levels and feedback, and each step's share of the mean time."""
    done = records.where("phase = 'done'")
    support = F.when(F.col("claims") > 0, F.col("share") * 100)
    means = {s: F.avg(F.coalesce(F.col(s), F.lit(0.0))) for s in steps}
    rows = done.groupBy("session_id").agg(
        F.count("*").alias("answers"),
        F.count_if("truncated").alias("truncated"),
        F.round(F.avg("groundedness"), 6).alias("groundedness"),
        F.round(F.avg(support), 6).alias("support"),
        *[F.count_if(F.col("level") == x).alias(x.lower()) for x in ("High", "Medium", "Low")],
        *[F.avg(F.coalesce(F.col(s), F.lit(0.0))).alias(f"_{s}") for s in steps],
    )
    total = F.lit(0.0)
    for s in means:
        total = total + F.col(f"_{s}")
    rows = rows.withColumns({f"{s}_share": F.round(F.col(f"_{s}") / F.when(total == 0, 1.0).otherwise(total), 6) for s in steps}).drop(*[f"_{s}" for s in steps])
    voted = records.groupBy("session_id").agg(F.count_if(F.col("feedback") == "up").alias("up"), F.count_if(F.col("feedback") == "down").alias("down"))
    late = measure.nearest_rank_percentiles(done, ["session_id"], "total_ms", {"p50": 50, "p95": 95})
    return rows.join(late, "session_id", "left").join(voted, "session_id")

