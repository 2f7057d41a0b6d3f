"""Quality classifier: a linear hinge-loss model on n-gram indicators scaled by Naive Bayes log-count ratios.

Features of a text, each counted once: its byte 1-grams and 2-grams, its byte 3-grams (hashed), and n-grams of
"this word repeats the one before" marks. Training:

1. a bounded sample of labelled rows (``max_rows``, chosen by a hash of their ids) gets its features as a table;
2. Spark counts each feature by class, and the smoothed log-count ratios scale the indicators;
3. dual coordinate descent fits the hinge loss in one task, whose input is bounded by ``max_rows``;
4. held-back sample rows give the sigmoid that turns margins into probabilities.

Scoring reads each whole text once; the weights are one array of fixed size.

Defined cases: a null or empty text scores the sigmoid of the intercept; with labels of a single class (or none) every
score is that class's smoothed share; repeated label rows count once, with the higher label; repeated documents are
scored one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import drop_stash, stash
from tessella.llm.wordhash import texts, word_hashes

TRIGRAMS = 1 << 17
ONE, TWO, THREE, MARKS = 0, 256, 256 + 65536, 256 + 65536 + TRIGRAMS
SIZE = MARKS + 16


def features(data: np.ndarray, words: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Sorted feature numbers of one text; flags is a zeroed array of SIZE that is zeroed again."""
    if len(data):
        x = data.astype(np.int32)
        flags[x] = 1
        if len(x) > 1:
            two = x[:-1] << 8 | x[1:]
            flags[TWO + two] = 1
            three = (two[:-1] << 8 | x[2:]) * np.int32(-1640531527)
            flags[THREE + ((three >> 15) & (TRIGRAMS - 1))] = 1
    if len(words) > 1:
        same = (words[1:] == words[:-1]).astype(np.int32)
        flags[MARKS + same] = 1
        if len(same) > 1:
            pair = same[:-1] << 1 | same[1:]
            flags[MARKS + 2 + pair] = 1
            if len(pair) > 1:
                flags[MARKS + 6 + (pair[:-1] << 1 | same[2:])] = 1
    found = np.flatnonzero(flags)
    flags[found] = 0
    return found


def _each(column: pa.Array) -> Iterator[np.ndarray]:
    flags = np.zeros(SIZE, np.uint8)
    for _, data, offsets in texts(column):
        words, first = word_hashes(data, offsets)
        for i in range(len(offsets) - 1):
            yield features(data[offsets[i] : offsets[i + 1]], words[first[i] : first[i + 1]], flags)


def feature_list(text: Column) -> Column:
    """Feature numbers of each text (array<int>)."""

    @F.arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        found = [f.astype(np.int32) for f in _each(column)]
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*found, np.zeros(0, np.int32)])))

    return run(text.cast("string"))


def dual_coordinate_descent(
    rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, cost: float, epochs: int, seed: int = 7
) -> tuple[np.ndarray, float]:
    """Weights of the indicators (ratios included) and intercept of the L1-loss linear SVM."""
    rng = np.random.default_rng(seed)
    y = np.where(labels > 0, 1.0, -1.0)
    squares = np.array([ratios[r] @ ratios[r] for r in rows]) + 1.0
    # both classes weigh the same in all
    upper = cost * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    w, b, alpha = np.zeros(len(ratios)), 0.0, np.zeros(len(y))
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(y)):
            x = ratios[rows[i]]
            slope = y[i] * (w[rows[i]] @ x + b) - 1.0
            step = min(max(alpha[i] - slope / squares[i], 0.0), upper[i]) - alpha[i]
            if step:
                worst = max(worst, abs(step) * squares[i])
                alpha[i] += step
                w[rows[i]] += step * y[i] * x
                b += step * y[i]
        if worst < 1e-3:
            break
    return w * ratios, b


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    intercept: float
    slope: float
    shift: float

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def fit_sigmoid(margins: np.ndarray, positive: np.ndarray, total: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the class on the margin, from counts of margin bins, with one smoothing row a class."""
    target = (positive + 1e-9) / (total + 2e-9)
    n_pos, n_neg = positive.sum(), (total - positive).sum()
    high, low = (n_pos + 1) / (n_pos + 2), 1 / (n_neg + 2)
    target = target * high + (1 - target) * low
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([(total * (p - target) * margins).sum() + 1e-3 * a, (total * (p - target)).sum()])
        v = total * p * (1 - p)
        h = np.array([[(v * margins**2).sum() + 1e-3, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 0.0)), float(b)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    label: str = "quality",
    max_rows: int = 24_000,
    smoothing: float = 1.0,
    cost: float = 0.01,
    epochs: int = 20,
) -> Model:
    """Train on labels (key, label 0/1): at most about max_rows of them, of which a fifth fits the sigmoid."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("_y"))
    n = known.count()
    place = F.pmod(F.xxhash64(F.lit(11), key), F.lit(1_000_000))
    sample = known.where(place < int(1_000_000 * min(1.0, max_rows / max(n, 1))))
    # the sample is bounded by max_rows, so it may be broadcast
    rows = docs.select(key, text).join(F.broadcast(sample), key).dropDuplicates([key])
    held = F.pmod(F.xxhash64(F.lit(23), key), F.lit(5)) == 0
    rows = stash(rows.select(feature_list(F.col(text)).alias("f"), "_y", held.alias("_held")), "features")
    fitted = rows.where("not _held")
    sizes = {r[0]: r[1] for r in fitted.groupBy("_y").agg(F.count("*")).collect()}
    share = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
    if not (sizes.get(0) and sizes.get(1)):
        return Model(np.zeros(SIZE), 0.0, 0.0, math.log(share / (1 - share)))
    counts = fitted.select(F.explode("f").alias("f"), "_y").groupBy("f").agg(F.sum("_y").alias("p"), F.count("*").alias("n"))
    p, q = np.full(SIZE, smoothing), np.full(SIZE, smoothing)
    found = counts.toArrow()  # at most SIZE rows, one a feature
    f, positive, total = (found[c].to_numpy() for c in ("f", "p", "n"))
    p[f] += positive
    q[f] += total - positive
    ratios = np.log((p / p.sum()) / (q / q.sum()))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, y = [], []
        for batch in batches:
            own += [np.asarray(x.values) for x in batch.column(0)]
            y += batch.column(1).to_pylist()
        order = sorted(range(len(y)), key=lambda i: (len(own[i]), own[i].tobytes()))  # the same for any order of rows
        w, b = dual_coordinate_descent([own[i] for i in order], np.array([y[i] for i in order]), ratios, cost, epochs)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([b], pa.float64())], ["w", "b"])

    raw, intercept = fitted.select("f", F.col("_y").cast("int")).coalesce(1).mapInArrow(solve, "w binary, b double").first()
    weights = np.frombuffer(bytes(raw))
    unfitted = rows.where("_held")

    @F.arrow_udf("double")
    def margin(column: pa.Array) -> pa.Array:
        return pa.array([float(weights[np.asarray(x.values)].sum()) + intercept for x in column], pa.float64())

    bins = unfitted.select(F.round(margin("f") * 16).alias("m"), "_y").groupBy("m").agg(F.sum("_y"), F.count("*")).collect()
    drop_stash(rows)
    table = np.array([tuple(r) for r in bins], float).reshape(-1, 3)
    if not len(table) or not 0 < table[:, 1].sum() < table[:, 2].sum():
        return Model(weights, intercept, 1.0, 0.0)
    a, b = fit_sigmoid(table[:, 0] / 16, table[:, 1], table[:, 2])
    return Model(weights, intercept, a, b)


def scorer(model: Model):
    """Column function: the probability that a text is of class 1."""
    weights, intercept = model.weights, model.intercept

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        return pa.array(model.probability(np.array([float(weights[f].sum()) + intercept for f in _each(column)])), pa.float64())

    return run


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def quality_classifier(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.3, **options
) -> DataFrame:
    """docs with held_out, score and predicted (1 from the threshold on); columns of these names are replaced."""
    model = fit(docs, labels.where(~held_out(F.col(key))), text, key, **options)
    own = F.coalesce(held_out(F.col(key)), F.lit(False))
    scored = docs.withColumns({"held_out": own, "score": scorer(model)(F.col(text).cast("string"))})
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
