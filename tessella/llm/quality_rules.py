"""Quality rules: word statistics of whole texts, fixed base rules, and robust multivariate outliers.

All of it is DataFrame expressions. The statistic vectors of each (language, source) group get a minimum covariance
determinant estimate: from three starts, concentration steps keep the share ``support`` of the rows with the smallest
Mahalanobis distances and take mean and covariance from them until the determinants settle; the start with the smallest
determinant wins. The covariance has the factors that make it consistent for a normal law, and a fixed ridge (FLOORS): the
statistics of most documents are nearly constant, and the ridge says which differences matter at all. So distances are
at most those of the plain estimate, and the chi-square cut-off errs on the side of keeping. A reweighted estimate gives
the final distances.

Defined cases: a null or empty text has no words and fails the base rules; a very long text is judged whole, like
another; a null language or source is a value like another; groups of fewer than ``min_rows`` documents are pooled by
language, then all together, and a pool that is still smaller rejects nothing beyond the base rules; repeated rows are
judged one by one; an empty table gives an empty result; input columns named like an output are replaced.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import broadcast_if_small, drop_stash, stash

SPACE = r"[\x20\x09-\x0D]"
WINDOW = 8
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Smallest standard deviation of each transformed statistic, so that a group of nearly constant documents doesn't
#: reject small differences: log of the mean word length, log of symbols a word, share of repeated lines and of words
#: in repeated windows.
FLOORS = (0.06, 0.05, 0.12, 0.08)
P = len(FLOORS)
#: Share of a normal law that the reweighted estimate keeps.
REWEIGHT = 0.975
#: Columns of an estimate: mean and lower Cholesky factor.
ESTIMATE = [f"m{i}" for i in range(P)] + [f"l{i}{j}" for i in range(P) for j in range(i + 1)]


def chi2_cdf(x: float, dof: int) -> float:
    """Of a chi-square variable with an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dof // 2))


def chi2_quantile(q: float, dof: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, dof) < q else (low, mid)
    return high


def _bind(value: Column, body) -> Column:
    """body(value) with value computed once for each row, also where body uses it inside lambda functions."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Number of words in windows of WINDOW words that the text holds twice or more."""

    def covered(pairs: Column) -> Column:
        same = F.filter(
            pairs,
            lambda x, i: (F.get(pairs, i - 1)["h"].eqNullSafe(x["h"])) | (F.get(pairs, i + 1)["h"].eqNullSafe(x["h"])),
        )
        at = F.sort_array(F.transform(same, lambda x: x["p"]))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(
            at,
            zero,
            lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + F.least(F.lit(WINDOW), p + WINDOW - a["end"])).alias("n")),
            lambda a: a["n"],
        )

    def counted(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _bind(pairs, covered)).otherwise(0)

    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) > WINDOW, _bind(hashes, counted)).otherwise(0)


def statistics(text: Column) -> Column:
    """Struct of STATS (long) of a text."""
    text = F.coalesce(text, F.lit(""))
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != "")
    return _bind(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
            _bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeated(w).cast("long").alias("n_repeat_words"),
        ),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _vector() -> list[Column]:
    """The transformed statistics. The mean word length is drawn towards 5 by 30 words' weight, for short texts."""
    n = F.col("n_words")
    return [
        F.log((F.col("word_chars") + 150.0) / (n + 30.0)),
        F.log1p(F.col("n_symbols") / (n + 1.0)),
        F.col("n_dup_lines") / (n / 8.0 + F.col("n_dup_lines") + 1.0),
        F.col("n_repeat_words") / (n + 30.0),
    ]


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution in the Cholesky factor (columns l<i><j>, m<i>)."""
    z: list[Column] = []
    for i in range(P):
        rest = reduce(lambda s, j: s - F.col(f"l{i}{j}") * z[j], range(i), F.col(f"_x{i}") - F.col(f"m{i}"))
        z.append(rest / F.col(f"l{i}{i}"))
    return reduce(lambda s, x: s + x * x, z[1:], z[0] * z[0])


def _factor(rows: DataFrame, scale: float, keys: tuple[str, ...] = ("_g",)) -> DataFrame:
    """Mean, Cholesky factor of the scaled covariance (with the floors' squares on its diagonal) and log determinant."""
    sums = [F.avg(f"_x{i}").alias(f"m{i}") for i in range(P)]
    sums += [F.covar_pop(f"_x{i}", f"_x{j}").alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)]
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), *sums)
    found = found.withColumns({f"c{i}{j}": F.col(f"c{i}{j}") * scale + (FLOORS[i] ** 2 if i == j else 0.0) for i in range(P) for j in range(i + 1)})
    return _cholesky(found).select(*keys, "n", *ESTIMATE, "logdet")


def _cholesky(rows: DataFrame) -> DataFrame:
    """rows with the factor l<i><j> of their covariance c<i><j> and its log determinant."""
    for i in range(P):
        for j in range(i + 1):
            value = reduce(lambda s, k: s - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.col(f"c{i}{j}"))
            rows = rows.withColumn(f"l{i}{j}", F.sqrt(value) if i == j else value / F.col(f"l{j}{j}"))
    return rows.withColumn("logdet", reduce(lambda s, i: s + 2 * F.log(f"l{i}{i}"), range(P), F.lit(0.0)))


def first_estimates(vectors: DataFrame) -> DataFrame:
    """(_g, start, m<i>, l<i><j>): three starts a group, all centred at the coordinatewise medians. Their shapes are the
    median absolute deviations alone, and with the correlations of squashed and of unit-length standardised vectors."""
    percentile = lambda c: F.percentile_approx(c, 0.5, 2000)
    middle = vectors.groupBy("_g").agg(*[percentile(f"_x{i}").alias(f"m{i}") for i in range(P)])
    middle = stash(middle, "mcd")
    small = broadcast_if_small(middle)
    spread = vectors.join(small, "_g").groupBy("_g").agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(P)],
        *[F.greatest(1.4826 * percentile(F.abs(F.col(f"_x{i}") - F.col(f"m{i}"))), F.lit(FLOORS[i])).alias(f"w{i}") for i in range(P)],
    )
    spread = stash(spread, "mcd")
    drop_stash(middle)
    zs = vectors.join(broadcast_if_small(spread), "_g").select("_g", *[((F.col(f"_x{i}") - F.col(f"m{i}")) / F.col(f"w{i}")).alias(f"z{i}") for i in range(P)])
    length = F.sqrt(reduce(lambda s, i: s + F.col(f"z{i}") * F.col(f"z{i}"), range(P), F.lit(0.0)))
    shapes = [
        F.struct(F.lit(1).alias("start"), *[F.tanh(f"z{i}").alias(f"y{i}") for i in range(P)]),
        F.struct(F.lit(2).alias("start"), *[F.when(length > 0, F.col(f"z{i}") / length).otherwise(0.0).alias(f"y{i}") for i in range(P)]),
    ]
    found = zs.select("_g", F.inline(F.array(*shapes))).groupBy("_g", "start")
    found = found.agg(*[F.covar_pop(f"y{i}", f"y{j}").alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)]).join(broadcast_if_small(spread), "_g")
    found = found.withColumns({f"c{i}{i}": F.col(f"c{i}{i}") + (FLOORS[i] / F.col(f"w{i}")) ** 2 for i in range(P)})
    found = _cholesky(found).withColumns({f"l{i}{j}": F.col(f"l{i}{j}") * F.col(f"w{i}") for i in range(P) for j in range(i + 1)})
    plain = {f"l{i}{j}": F.col(f"w{i}") if i == j else F.lit(0.0) for i in range(P) for j in range(i + 1)}
    found = spread.withColumns(plain).withColumn("start", F.lit(0)).select("_g", "start", *ESTIMATE).unionByName(found.select("_g", "start", *ESTIMATE))
    found = stash(found, "mcd")
    drop_stash(spread)
    return found


def _measured(vectors: DataFrame, at: DataFrame, *keys: str) -> DataFrame:
    """vectors with their squared distance _d by the estimates of their group."""
    return vectors.join(broadcast_if_small(at), "_g").select("_g", *keys, *[f"_x{i}" for i in range(P)], _distance().alias("_d"))


def estimate(vectors: DataFrame, support: float, max_steps: int) -> DataFrame:
    """MCD estimates of rows (_g, _x0.._x3), a small stashed table of one row a group: (_g, n, m<i>, l<i><j>, logdet).

    Concentration steps run from each start until all determinants settle; the smallest determinant wins."""
    at = first_estimates(vectors)
    consistency = support / chi2_cdf(chi2_quantile(support, P), P + 2)
    before: float | None = None
    for _ in range(max_steps):
        measured = _measured(vectors, at, "start")
        cut = measured.groupBy("_g", "start").agg(F.percentile_approx("_d", support, 2000).alias("_cut"))
        cut = stash(cut, "mcd")
        inner = measured.join(broadcast_if_small(cut), ["_g", "start"]).where("_d <= _cut")
        new = stash(_factor(inner, consistency, ("_g", "start")), "mcd")
        drop_stash(at, cut)
        at = new
        total, n = at.agg(F.sum("logdet"), F.count("*")).first()
        if before is not None and abs((total or 0) - before) <= 1e-4 * max(n, 1):
            break
        before = total or 0
    best = at.groupBy("_g").agg(F.min(F.struct("logdet", "start", *ESTIMATE)).alias("b")).select("_g", "b.*").drop("start", "logdet")
    best = stash(best, "mcd")
    inner = _measured(vectors, best).where(F.col("_d") <= chi2_quantile(REWEIGHT, P))
    final = stash(_factor(inner, REWEIGHT / chi2_cdf(chi2_quantile(REWEIGHT, P), P + 2)), "mcd")
    drop_stash(at, best)
    return final


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    support: float = 0.75,
    confidence: float = 0.99999,
    min_rows: int = 60,
    max_steps: int = 12,
) -> DataFrame:
    """docs with STATS, base_failed, distance (squared, null if there is no estimate) and kept.

    The texts are read once; their rows with statistics are stashed, and each concentration step reads the four
    narrow vector columns only. Estimates are one row a group and join by the group's key.
    """
    if not {lang, source} <= set(docs.columns):
        docs = docs.withColumns({c: F.lit(None).cast("string") for c in (lang, source) if c not in docs.columns})
    own = docs.withColumn("_s", statistics(F.col(text)))
    own = own.withColumns({s: F.col(f"_s.{s}") for s in STATS}).drop("_s").withColumn("base_failed", base_failed())
    own = stash(own.withColumns({f"_x{i}": x for i, x in enumerate(_vector())}), "quality-rules")

    # languages and sources are few, but not provably: counts stay in Spark
    sizes = own.where("not base_failed").groupBy(F.col(lang).alias("_l"), F.col(source).alias("_o")).agg(F.count("*").alias("_n"))
    small = F.col("_n") < min_rows
    pools = sizes.where(small).groupBy("_l").agg(F.sum("_n").alias("_p"))
    named = sizes.join(pools.withColumnRenamed("_l", "_pl"), F.col("_l").eqNullSafe(F.col("_pl")), "left")
    # a group, a language's small sources and all the rest never share a key: nulls are written out, and the kind leads
    tag = lambda kind, *c: F.concat(F.lit(kind), F.to_json(F.struct(*c), {"ignoreNullFields": "false"}))
    key = F.when(~small, tag("group", "_l", "_o")).when(F.col("_p") >= min_rows, tag("language", "_l")).otherwise("all")
    named = stash(named.select("_l", "_o", key.alias("_g")), "mcd")
    xs = [f"_x{i}" for i in range(P)]
    vectors = own.where("not base_failed").select(F.col(lang).alias("_vl"), F.col(source).alias("_vo"), *xs)
    vectors = vectors.join(broadcast_if_small(named), F.col("_l").eqNullSafe(F.col("_vl")) & F.col("_o").eqNullSafe(F.col("_vo"))).select("_g", *xs)
    found = estimate(vectors, support, max_steps)
    params = stash(named.join(found.where(F.col("n") >= support * min_rows / 2).drop("n", "logdet"), "_g", "left").drop("_g"), "mcd")
    drop_stash(named, found)
    cond = F.col("_l").eqNullSafe(F.col(f"_own.{lang}")) & F.col("_o").eqNullSafe(F.col(f"_own.{source}"))
    clash = {c: c for c in own.columns if c in ESTIMATE}
    if clash:  # columns of the input with an estimate's name are set aside meanwhile
        own = own.withColumnsRenamed({c: f"_in_{c}" for c in clash})
    judged = own.alias("_own").join(broadcast_if_small(params), cond, "left").withColumn("distance", _distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2_quantile(confidence, P), F.lit(True))
    judged = judged.withColumn("kept", kept).drop("_l", "_o", *ESTIMATE, *xs)
    return judged.withColumnsRenamed({f"_in_{c}": c for c in clash}) if clash else judged
