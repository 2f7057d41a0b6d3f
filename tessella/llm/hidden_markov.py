"""A hidden Markov language model over whole texts.

Tokens are lower-cased words and one end mark a text. The model of a word w in state s is B[s, x(w)] * Q(w):

* x(w) is the symbol of w: its own for the ``head`` most frequent words and for the end mark, else its spelling class;
* Q(w) is 1 for a word with an own symbol. In a spelling class with N counted tokens, of which n1 are words seen once, a
  counted word has (1 - u) * c / N, and all words that were never counted share u = (n1 + 0.5) / (N + 1).

So the probabilities of the counted words, the end mark and the uncounted words of each class add up to 1 in each state.

1. Spark counts all words of the learning texts (pre-aggregated in each batch, then summed by the word's hash).
2. Texts become arrays of symbols. Counts of the ``lookup`` most frequent words at most travel as one bounded table; all other
   words are counted within their text, joined with the table of counts, and their logarithms summed by text.
3. A start from all learning texts: Spark counts how often each symbol stands before and after each of the ``NEIGHBOURS`` most
   frequent ones (the rest together), and ``rounds`` rounds of expectation maximisation fit the states to these pairs alone,
   in the driver (symbols x neighbours numbers, however long the texts are).
   Baum-Welch: ``passes`` passes over all learning texts; each partition gathers its expected counts in arrays of fixed size,
   Spark sums them, the driver (whose share is symbols x states numbers) makes the next parameters.
4. Scaled forward recursion in double precision gives each text's exact likelihood.

Words are told apart by 64-bit hashes: two of a million words are the same with a chance of 3e-8.

Defined cases: a null or empty text is its end mark alone; a row with a null key is learned from; repeated rows are counted
and scored each; without learning texts every word is uncounted, and N and V are 0; texts of any length are processed
whole, in memory bounded by ``WAVE`` tokens (and some numbers for each further segment).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.shared import drop_stash, stash
from tessella.llm.wordhash import texts
from tessella.llm.words import CLASSES, LOWER, byte_set, hashes, spans, spelling

OUTSIDE = byte_set([0x20, *range(0x09, 0x0E)])
#: Symbols: the end mark, the spelling classes, then words of their own.
END, FIRST_CLASS, FIRST_WORD = 0, 1, 1 + CLASSES
#: Tokens whose state probabilities are in memory at once.
WAVE = 200_000
#: Symbols told apart as neighbours at the start of the learning: the most frequent ones, and one for all others.
NEIGHBOURS = 64
#: Pseudo-counts of a state: of the overall symbol distribution, and of each transition.
PRIOR, STEP_PRIOR = 20.0, 0.5


def held_out(key: Column) -> Column:
    """Rows that aren't learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, text of each word, hash, class) for blocks of texts."""
    for i, data, offsets in texts(column):
        data = LOWER[data]
        starts, ends = spans(data, offsets, OUTSIDE)
        counts = np.diff(np.searchsorted(starts, offsets))
        yield i, len(counts), np.repeat(np.arange(len(counts)), counts), hashes(data, starts, ends), spelling(data, starts, ends)


def count_words(learned: DataFrame, text: str) -> DataFrame:
    """A stashed table (hash, cls, c) of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, h, cls in _words(batch.column(0)):
                found, first, n = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(cls[first].astype(np.int8)), pa.array(n)], ["hash", "cls", "n"])

    counts = learned.select(F.col(text).cast("string")).mapInArrow(run, "hash long, cls byte, n long")
    return stash(counts.groupBy("hash").agg(F.max("cls").alias("cls"), F.sum("n").alias("c")), "word-counts")


@dataclass
class Vocabulary:
    """What all tasks know of the counts; ``hashes`` and ``counts`` hold the most frequent words, in this order."""

    texts: int
    tokens: int
    types: int
    hashes: np.ndarray
    counts: np.ndarray
    head: int
    complete: bool
    log_seen: np.ndarray  # of each class: log10((1 - u) / N)
    log_unseen: np.ndarray  # log10(u)
    symbol_counts: np.ndarray
    index: pd.Index | None = field(default=None, repr=False)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Rank of each hash, or -1."""
        if self.index is None:
            self.index = pd.Index(self.hashes)
        return self.index.get_indexer(h)

    @property
    def log_total(self) -> float:
        """log10 of the base model's denominator."""
        return math.log10(self.tokens + 0.1 * (self.types + 1))


def vocabulary(counts: DataFrame, n_texts: int, head: int, lookup: int) -> Vocabulary:
    """The bounded part of the counts. Words of equal count stand together in or outside of the lookup table: steps of the
    count's logarithm (at most some thousands) are counted, and whole steps are taken from the top."""
    step = F.floor(F.log2("c") * 64).cast("int")
    steps = sorted(counts.groupBy(step.alias("s")).agg(F.count("*"), F.sum("c")).collect(), reverse=True)
    types, tokens = sum(r[1] for r in steps), sum(r[2] for r in steps)
    taken, least = 0, math.inf
    for s, n, _ in steps:
        if taken + n > lookup:
            break
        taken, least = taken + n, s
    found = counts.where(step >= least).select("hash", "cls", "c").toArrow() if taken else None
    h, cls, c = (found[k].to_numpy() for k in ("hash", "cls", "c")) if taken else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((h, -c))
    h, cls, c = h[order], cls[order].astype(np.int64), c[order]
    own = min(head, taken)
    n, once = np.zeros(CLASSES), np.zeros(CLASSES)
    for k, total, singles in counts.groupBy("cls").agg(F.sum("c"), F.sum((F.col("c") == 1).cast("long"))).collect():
        n[k], once[k] = total, singles
    np.subtract.at(n, cls[:own], c[:own])
    np.subtract.at(once, cls[:own], c[:own] == 1)
    unseen = np.where(n > 0, (once + 0.5) / (n + 1), 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        log_seen = np.where(n > 0, np.log10(1 - unseen) - np.log10(n), 0.0)
    of_symbol = np.concatenate([[n_texts], n, c[:own]])
    return Vocabulary(n_texts, tokens + n_texts, types + (n_texts > 0), h, c, own, taken == types, log_seen, np.log10(unseen), of_symbol)


def encode(docs: DataFrame, key: str, text: str, held: Column, words: Vocabulary) -> DataFrame:
    """A stashed table: _uid, key, held_out, n_tokens, sums over the words found in the lookup table, the symbols (16 bits
    each, the end mark last) and the words that aren't in the table (hash, cls, n)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(words)  # bounded: ``lookup`` words
    rows = docs.select(F.col(key).alias("_key"), held.alias("held_out"), F.col(text).cast("string").alias("_text"))
    rest = T._parse_datatype_string("array<struct<hash: long, cls: byte, n: long>>")
    schema = T.StructType(rows.schema.fields[:2])
    for name, kind in (("n_tokens", T.LongType()), ("known", T.LongType()), ("base", T.DoubleType()), ("inner", T.DoubleType()), ("symbols", T.BinaryType()), ("rest", rest)):
        schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        base_of = np.log10(words.counts + 0.1)
        inner_of = np.log10(words.counts)
        inner_of[: words.head] = 0.0
        for batch in batches:
            for i, m, row, h, cls in _words(batch.column(2)):
                rank = words.find(h)
                known, own = rank >= 0, (rank >= 0) & (rank < words.head)
                n = np.bincount(row, minlength=m)
                symbols = np.zeros(len(row) + m, np.uint16)
                symbols[np.arange(len(row)) + row] = np.where(own, FIRST_WORD + rank, FIRST_CLASS + cls)
                base, inner = np.zeros(len(row)), np.zeros(len(row))
                base[known] = base_of[rank[known]]
                inner[known] = inner_of[rank[known]] + np.where(own[known], 0.0, words.log_seen[cls[known]])
                out = np.flatnonzero(~known)
                if words.complete:  # all counted words are in the table, so these have count 0
                    base[out], inner[out] = math.log10(0.1), words.log_unseen[cls[out]]
                    out = out[:0]
                out = out[np.lexsort((h[out], row[out]))]
                new = np.ones(len(out), bool)
                new[1:] = (h[out][1:] != h[out][:-1]) | (row[out][1:] != row[out][:-1])
                at = np.flatnonzero(new)
                first, times = out[at], np.diff(np.append(at, len(out)))
                rest = pa.StructArray.from_arrays([pa.array(h[first]), pa.array(cls[first].astype(np.int8)), pa.array(times.astype(np.int64))], ["hash", "cls", "n"])
                ends = np.concatenate([[0], np.cumsum(n + 1)]) * 2
                columns = [
                    batch.column(0).slice(i, m),
                    batch.column(1).slice(i, m),
                    pa.array((n + 1).astype(np.int64)),
                    pa.array(np.bincount(row, known, m).astype(np.int64) + (words.texts > 0)),
                    pa.array(np.bincount(row, base, m) + math.log10(words.texts + 0.1), pa.float64()),
                    pa.array(np.bincount(row, inner, m), pa.float64()),
                    pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(symbols)]),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(row[first], np.arange(m + 1)).astype(np.int32)), rest),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return stash(rows.mapInArrow(run, schema).withColumn("_uid", F.monotonically_increasing_id()), "symbols")


@dataclass
class Model:
    """Probabilities of the first state, of the next state (states x states) and of the symbols (symbols x states)."""

    first: np.ndarray
    step: np.ndarray
    emit: np.ndarray


class Waves:
    """Sequences side by side, longest first. Token t of sequence i is at off[t] + i; act[t] sequences have a token t."""

    def __init__(self, sequences: list[np.ndarray]):
        self.order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        lengths = np.array([len(sequences[i]) for i in self.order])
        flat = np.concatenate([sequences[i] for i in self.order])
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        t = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.act = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
        self.off = np.concatenate([[0], np.cumsum(self.act)])
        self.at = self.off[t] + self.doc
        self.symbols = np.empty(len(flat), flat.dtype)
        self.symbols[self.at] = flat

    @staticmethod
    def of(sequences: list[np.ndarray], most: int = WAVE) -> Iterator[tuple[list[int], Waves]]:
        """(places in the list, wave): sequences of like length, ``most`` tokens together or one longer sequence."""
        order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        own, size = [], 0
        for i in order:
            if own and size + len(sequences[i]) > most:
                yield own, Waves([sequences[j] for j in own])
                own, size = [], 0
            own.append(i)
            size += len(sequences[i])
        if own:
            yield own, Waves([sequences[j] for j in own])

    def segments(self, most: int) -> list[tuple[int, int]]:
        """Ranges of t with about ``most`` tokens each."""
        cuts = [0]
        while cuts[-1] < len(self.act):
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(self.off, self.off[cuts[-1]] + most, "right")) - 1))
        return list(zip(cuts[:-1], cuts[1:]))


def forward(model: Model, wave: Waves, t0: int, t1: int, a: np.ndarray | None, scale: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
    """Scaled forward recursion over tokens t0 to t1 - 1, from the state probabilities a after token t0 - 1; scale (of the
    tokens) gets each token's probability given those before it, keep the state probabilities after each token."""
    start = wave.off[t0]
    for t in range(t0, t1):
        n, lo = wave.act[t], wave.off[t]
        emitted = model.emit[wave.symbols[lo : lo + n]]
        a = (emitted * model.first) if t == 0 else (a[:n] @ model.step) * emitted
        s = a.sum(1)
        a /= s[:, None]
        scale[lo - start : lo - start + n] = s
        if keep is not None:
            keep[lo - start : lo - start + n] = a
    return a


class Expected:
    """Expected counts of Baum-Welch over any number of sequences."""

    def __init__(self, model: Model):
        self.model = model
        self.first, self.step, self.emit = (np.zeros(x.shape) for x in (model.first, model.step, model.emit))
        self.log, self.tokens = 0.0, 0

    def add(self, sequences: list[np.ndarray], most: int = WAVE) -> None:
        for _, wave in Waves.of(sequences, most):
            self._add(wave, most)

    def _add(self, wave: Waves, most: int) -> None:
        """Exact expectations in bounded memory: the state at each segment's start is kept from a first sweep, and a segment's own
        probabilities are computed again when the backward sweep comes to it."""
        model, kind = self.model, self.model.emit.dtype
        parts = wave.segments(most)
        before: list[np.ndarray | None] = [None]
        for t0, t1 in parts[:-1]:
            before.append(forward(model, wave, t0, t1, before[-1], np.empty(wave.off[t1] - wave.off[t0], kind)))
        later: np.ndarray | None = None  # emission * backward / scale of token t + 1
        xi = np.zeros(self.step.shape)
        for (t0, t1), a in zip(reversed(parts), reversed(before)):
            start, size = wave.off[t0], wave.off[t1] - wave.off[t0]
            scale, alpha = np.empty(size, kind), np.empty((size, len(model.first)), kind)
            forward(model, wave, t0, t1, a, scale, alpha)
            gamma = np.empty_like(alpha)
            for t in reversed(range(t0, t1)):
                n, lo = wave.act[t], wave.off[t] - start
                own = alpha[lo : lo + n]
                beta = np.ones_like(own)
                if later is not None:
                    beta[: len(later)] = later @ model.step.T
                    xi += own[: len(later)].T @ later
                gamma[lo : lo + n] = own * beta
                later = model.emit[wave.symbols[wave.off[t] : wave.off[t] + n]] * beta / scale[lo : lo + n, None]
            self.log += float(np.log10(scale.astype(np.float64)).sum())
            symbols = wave.symbols[start : start + size]
            for k in range(gamma.shape[1]):
                self.emit[:, k] += np.bincount(symbols, gamma[:, k], len(self.emit))
            if t0 == 0:
                self.first += gamma[: wave.act[0]].sum(0)
            self.tokens += size
        self.step += xi * model.step


def next_model(first: np.ndarray, step: np.ndarray, emit: np.ndarray, overall: np.ndarray) -> Model:
    """Parameters from expected counts; overall: the symbols' own distribution, the prior of each state."""
    first = (first + STEP_PRIOR) / (first.sum() + STEP_PRIOR * len(first))
    step = (step + STEP_PRIOR) / (step.sum(1, keepdims=True) + STEP_PRIOR * len(step))
    emit = (emit + PRIOR * overall[:, None]) / (emit.sum(0) + PRIOR)
    return Model(first, step, emit)


def single(model: Model) -> Model:
    """The model in single precision, for learning."""
    return Model(*(x.astype(np.float32) for x in (model.first, model.step, model.emit)))


def first_model(states: int, overall: np.ndarray, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    emit = overall[:, None] * np.exp(0.5 * rng.standard_normal((len(overall), states)))
    step = 0.3 * np.eye(states) + 0.7 / states
    return Model(np.full(states, 1 / states), step, emit / emit.sum(0))


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint16) for x in column]


def _blocks(batches: Iterator[pa.RecordBatch], most: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of batches of about ``most`` tokens, with their sequences."""
    for batch in batches:
        sizes = np.cumsum(np.diff(np.frombuffer(batch.column(0).buffers()[1], np.int32, len(batch) + 1, batch.column(0).offset * 4))) // 2
        i = 0
        while i < len(batch):
            j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + most, "right")))
            part = batch.slice(i, j - i)
            yield part, _sequences(part.column(0))
            i = j


def neighbour_of(words: Vocabulary) -> np.ndarray:
    """Of each symbol the neighbour it counts as."""
    n = min(NEIGHBOURS, len(words.symbol_counts))
    column = np.full(len(words.symbol_counts), n - 1)
    column[np.argsort(-words.symbol_counts, kind="stable")[: n - 1]] = np.arange(n - 1)
    return column


def pair_counts(learned: DataFrame, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tables (symbols x neighbours) over all texts: how often each symbol has the neighbour before it, and after it. The end mark
    stands before a text's first word."""
    symbols, n = len(column), int(column.max()) + 1
    shared = learned.sparkSession.sparkContext.broadcast(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column, total = shared.value, np.zeros(2 * symbols * n, np.int64)
        for _, sequences in _blocks(batches):
            own = np.concatenate(sequences).astype(np.int64)
            last = np.empty_like(own)
            last[1:] = own[:-1]
            last[np.cumsum([0, *(len(s) for s in sequences[:-1])])] = END
            total[: symbols * n] += np.bincount(own * n + column[last], minlength=symbols * n)
            total[symbols * n :] += np.bincount(last * n + column[own], minlength=symbols * n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "n"])

    found = learned.select("symbols").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * symbols * n)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    shared.destroy()
    return tuple(out.reshape(2, symbols, n))


def pair_model(model: Model, before: np.ndarray, after: np.ndarray, column: np.ndarray, rounds: int, overall: np.ndarray) -> Model:
    """Expectation maximisation over the pairs of pair_counts: a pair's first state has its share of all tokens, its second
    follows by a step, and each emits its side."""
    emit, step, n = model.emit, model.step, before.shape[1]
    share = np.full(len(step), 1 / len(step))
    for _ in range(rounds):
        side = np.stack([np.bincount(column, emit[:, k], n) for k in range(len(step))], axis=1)  # emission of a neighbour
        own, later = emit * share, side @ step.T
        ratio = after / (own @ later.T)
        counts, steps = own * (ratio @ later), step * (own.T @ ratio @ side)
        earlier = (side * share) @ step
        ratio = before / (emit @ earlier.T)
        counts += emit * (ratio @ earlier)
        steps += step * ((side * share).T @ (ratio.T @ emit))
        share = counts.sum(0) / counts.sum()
        made = next_model(share, steps / 2, counts / 2, overall)  # each token is in two pairs
        step, emit = made.step, made.emit
    first = (share * emit[END]) @ step  # the state after an end mark
    return Model(first / first.sum(), step, emit)


def baum_welch(learned: DataFrame, words: Vocabulary, states: int, rounds: int, passes: int) -> Model:
    """learned: rows with symbols."""
    overall = (words.symbol_counts + 0.5) / (words.symbol_counts.sum() + 0.5 * len(words.symbol_counts))
    model = first_model(states, overall)
    if not words.texts:
        return model
    spark = learned.sparkSession
    names = [f"c{k}" for k in range(states)]
    schema = "id int, " + ", ".join(f"{c} double" for c in names)

    def table(e: Expected) -> pa.RecordBatch:
        """Counts by id: from 0 the symbols, -1 the first state, from -2 down the states stepped from."""
        seen = np.flatnonzero(e.emit.any(1))
        values = np.concatenate([e.first[None], e.step, e.emit[seen]])
        ids = np.concatenate([-1 - np.arange(1 + states), seen]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(values[:, k]) for k in range(states))], ["id", *names])

    def made(found: pa.Table) -> Model:
        ids, values = found["id"].to_numpy(), np.stack([found[c].to_numpy() for c in names], axis=1)
        emit, step = np.zeros(model.emit.shape), np.zeros(model.step.shape)
        emit[ids[ids >= 0]] = values[ids >= 0]
        step[-2 - ids[ids < -1]] = values[ids < -1]
        return next_model(values[ids == -1].sum(0), step, emit, overall)

    if rounds:
        column = neighbour_of(words)
        model = pair_model(model, *pair_counts(learned, column), column, rounds, overall)
    for _ in range(passes):
        shared = spark.sparkContext.broadcast(single(model))  # symbols x states numbers

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            e = Expected(shared.value)
            for _, sequences in _blocks(batches):
                e.add(sequences)
            yield table(e)

        counts = learned.select("symbols").mapInArrow(run, schema)
        model = made(counts.groupBy("id").agg(*(F.sum(c).alias(c) for c in names)).toArrow())
        shared.destroy()
    return model


def log_likelihood(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 of each sequence's probability."""
    out = np.zeros(len(sequences))
    for own, wave in Waves.of(sequences):
        logs, a = np.zeros(len(own)), None
        for t0, t1 in wave.segments(WAVE):
            lo, hi = wave.off[t0], wave.off[t1]
            scale = np.empty(hi - lo)
            a = forward(model, wave, t0, t1, a, scale)
            column = np.arange(hi - lo) - np.repeat(wave.off[t0:t1] - lo, wave.act[t0:t1])
            logs += np.bincount(column, np.log10(scale), len(own))
        out[[own[i] for i in wave.order]] = logs
    return out


def language_model(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    held: Column | None = None,
    states: int = 16,
    rounds: int = 150,
    passes: int = 3,
    head: int = 16_000,
    lookup: int = 1 << 20,
) -> DataFrame:
    """One row for each row of docs: key, held_out, n_tokens, n_known, train_tokens, base_score (log10 of the smoothed
    unigram probability) and score (log10 of the model's probability of the text)."""
    if FIRST_WORD + head > 1 << 16:
        raise ValueError("symbols are 16-bit numbers")
    held = held_out(F.col(key)) if held is None else held
    learned = docs.where(~held)
    counts = count_words(learned, text)
    words = vocabulary(counts, learned.count(), head, lookup)
    rows = encode(docs, key, text, held, words)
    model = baum_welch(rows.where(~F.col("held_out")), words, states, rounds, passes)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sequences in _blocks(batches):
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(log_likelihood(shared.value, sequences))], ["_uid", "hidden"])

    if words.complete:  # no word is left to be joined
        scored = rows.select("symbols", F.struct(*[c for c in rows.columns if c not in ("symbols", "rest")]).alias("_uid"))
        kind = scored.schema["_uid"].dataType
        scored = scored.mapInArrow(run, T.StructType([T.StructField("_uid", kind), T.StructField("hidden", T.DoubleType())])).select("_uid.*", "hidden")
        known, base, inner = F.col("known"), F.col("base"), F.col("inner")
    else:
        rest = rows.select("_uid", F.explode("rest").alias("w")).select("_uid", "w.*")
        of_class = lambda values: F.element_at(F.array(*(F.lit(float(x)) for x in values)), F.col("cls").cast("int") + 1)
        found = rest.join(counts.select("hash", "c"), "hash", "left").withColumn("c", F.coalesce("c", F.lit(0)))
        inner = F.when(F.col("c") > 0, of_class(words.log_seen) + F.log10(F.greatest("c", F.lit(1)))).otherwise(of_class(words.log_unseen))
        sums = found.groupBy("_uid").agg(
            F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rest_known"),
            F.sum(F.col("n") * F.log10(F.col("c") + 0.1)).alias("rest_base"),
            F.sum(F.col("n") * inner).alias("rest_inner"),
        )
        scored = rows.select("symbols", "_uid").mapInArrow(run, "_uid long, hidden double")
        scored = rows.drop("symbols", "rest").join(scored, "_uid").join(sums, "_uid", "left")
        known, base, inner = (F.col(c) + F.coalesce(f"rest_{c}", F.lit(0)) for c in ("known", "base", "inner"))
    return scored.select(
        F.col("_key").alias(key),
        "held_out",
        "n_tokens",
        known.cast("long").alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (base - F.col("n_tokens") * words.log_total).alias("base_score"),
        (F.col("hidden") + inner).alias("score"),
    )
