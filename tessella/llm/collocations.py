"""Phrases of two and more words that stand together more often than their parts, per language.

A table of chunks holds the words of many texts of one language as an array of numbers. Level by level (words, then phrases
of 2, 3, ... words):

1. each chunk's own counts are summed over all chunks; what comes to ``least`` is frequent and gets an id, ranked by frequency;
2. ids go back to the chunks: a table of at most ``SMALL`` frequent entries goes to every task, a larger one is joined with each
   chunk's own distinct entries, so that no task needs it whole;
3. in a chunk, the pairs of neighbouring ids are counted by direct-address tiles: ids are split into ranges of ``SIDE``, so
   a pair belongs to a tile of SIDE x SIDE cells; a tile with many pairs is counted by a dense bincount, all others as sorted
   coordinates with run lengths. Frequent ids are small, so the few tiles near the origin hold most pairs.

A frequent pair of phrases of k words that share k - 1 words is a phrase of k + 1 words; its rank is the id of the next level.
A phrase can't be more frequent than its parts, so nothing frequent is lost. Entries with a count below ``least`` are never
sent back, and no list of all pairs of a group is made: rows are at most the positions of the texts.

Defined cases: a null text has no words; a null language is ``und``; repeated rows count each; empty tables give no rows;
texts of any length are read whole (a text longer than CHUNK is a chunk of its own); clashing columns of the input aren't
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.shared import broadcast_if_small, drop_stash, ranked, stash
from tessella.llm.wordhash import mix, texts
from tessella.llm.words import LOWER, byte_set, spans

#: Bytes between words, and bytes between the pieces that a phrase can't cross.
SPACE, BREAK = byte_set([0x20, 0x09]), byte_set([*map(ord, ".,;:!?"), *range(0x0A, 0x0E)])
#: Bytes of text in a chunk: its row is small for the JVM.
CHUNK = 256 << 10
#: Ids in a tile's side; pairs from which a tile is dense; pairs that a task counts at once.
SIDE, DENSE, AT_ONCE = 1024, 1 << 16, 1 << 18
#: Entries of a level that may go to every task; more are joined by their keys.
SMALL = 1_000_000


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The texts' words as numbers from 1 on, 0 between pieces, and the distinct words in the order of their numbers."""
    data = LOWER[data]
    starts, ends = spans(data, offsets, SPACE | BREAK)
    inside = ~(SPACE | BREAK)[data]
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[inside])]).dictionary_encode()
    before = np.concatenate([[0], np.cumsum(BREAK[data], dtype=np.int32)])[starts]  # breaks before each word
    row = np.searchsorted(offsets, starts, "right")
    apart = np.zeros(len(starts), np.int64)
    apart[1:] = (before[1:] != before[:-1]) | (row[1:] != row[:-1])
    codes = np.zeros(len(starts) + int(apart.sum()), np.int32)
    codes[np.arange(len(starts)) + np.cumsum(apart)] = words.indices.to_numpy(zero_copy_only=False) + 1
    return codes, words.dictionary


def pair_counts(a: np.ndarray, b: np.ndarray, side: int = SIDE, dense: int = DENSE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of ids (from 1 on) and how often each occurs."""
    x, y = a.astype(np.int64) - 1, b.astype(np.int64) - 1
    tile = (x // side) << 32 | y // side
    found, out = [], np.ones(len(x), bool)
    near = tile[(x < 64 * side) & (y < 64 * side)]
    sizes = np.bincount((near >> 32) * 64 + (near & 63), minlength=1)
    for t in np.flatnonzero(sizes >= dense):
        own = tile == ((t >> 6) << 32 | t & 63)
        cells = np.bincount((x[own] % side) * side + y[own] % side)
        full = np.flatnonzero(cells)
        found.append((full // side + (t >> 6) * side, full % side + (t & 63) * side, cells[full]))
        out &= ~own
    keys, n = np.unique(x[out] << 32 | y[out], return_counts=True)
    found.append((keys >> 32, keys & 0xFFFFFFFF, n))
    x, y, n = (np.concatenate(v) for v in zip(*found))
    return x + 1, y + 1, n


def _texts(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array]]:
    """(language as a column of one row, symbols, words) of chunks of texts of one language; batches: lang, text."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        code = langs.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        column, code = batch.column(1).take(pa.array(order)), code[order]
        cuts = np.flatnonzero(np.diff(code, prepend=-1))
        for i, j in zip(cuts, [*cuts[1:], len(code)]):
            for _, data, offsets in texts(column.slice(i, j - i), chunk):
                symbols, words = word_codes(data, offsets)
                yield langs.dictionary.take(pa.array([code[i]])), symbols, words.cast(pa.large_string()).cast(pa.string())


def squeezed(symbols: np.ndarray) -> np.ndarray:
    """symbols with one 0 for each run of them: who stands next to whom stays."""
    keep = symbols != 0
    keep[1:] |= symbols[:-1] != 0
    return symbols[keep]


def _rows(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))


def _word_counts(rows: DataFrame, chunk: int) -> DataFrame:
    """(lang, a, n): words and their counts, a row for each word of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, symbols, words in _texts(batches, chunk):
            n = np.bincount(symbols, minlength=len(words) + 1)[1:]
            yield pa.RecordBatch.from_arrays([lang.take(pa.array(np.zeros(len(words), np.int64))), words, pa.array(n, pa.int64())], ["lang", "a", "n"])

    return rows.mapInArrow(run, "lang string, a string, n long")


def _coded(rows: DataFrame, chunk: int, table: Broadcast) -> DataFrame:
    """The chunks of the words level (chunk, lang, symbols), stashed: ids from the table (_lookup), 0 for other words and between
    pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, symbols, words in _texts(batches, chunk):
            places = pc.index_in(words, table.value.get(lang[0].as_py(), pa.array([], pa.string())))
            ids = np.zeros(len(words) + 1, np.int32)
            ids[1:] = pc.add(places, 1).fill_null(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([lang, pa.array([squeezed(ids[symbols]).tobytes()], pa.binary())], ["lang", "symbols"])

    return stash(rows.mapInArrow(run, "lang string, symbols binary").withColumn("chunk", F.monotonically_increasing_id()), "symbols")


def _words(rows: DataFrame, chunk: int) -> DataFrame:
    """(chunk, lang, symbols, a), stashed: symbols are places in a, the chunk's words, from 1 on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, symbols, words in _texts(batches, chunk):
            yield pa.RecordBatch.from_arrays([lang, pa.array([symbols.tobytes()], pa.binary()), _lists(words)], ["lang", "symbols", "a"])

    found = rows.mapInArrow(run, "lang string, symbols binary, a array<string>")
    return stash(found.withColumn("chunk", F.monotonically_increasing_id()), "words")


def _lists(values: pa.Array) -> pa.Array:
    """A column of one row that holds values as a list."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _lookup(frequent: DataFrame, level: int) -> dict:
    """Of each language the frequent words by their ids, or the keys of frequent pairs in order with their ids."""
    rows = frequent.select("lang", "id", *(["a"] if level == 1 else [_key().alias("a")])).toArrow().combine_chunks()
    out, langs = {}, rows["lang"].combine_chunks().dictionary_encode() if len(rows) else pa.array([], pa.string()).dictionary_encode()
    code = langs.indices.to_numpy(zero_copy_only=False)
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        own = rows.take(pa.array(np.flatnonzero(code == k))).sort_by("id" if level == 1 else "a")
        out[lang] = own["a"].combine_chunks() if level == 1 else (own["a"].to_numpy(), own["id"].to_numpy())
    return out


def _key() -> Column:
    return F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long"))


def _replaced(chunks: DataFrame, level: int, table: Broadcast | None = None, ids: DataFrame | None = None) -> DataFrame:
    """The chunks of the next level, stashed: symbols are ids of frequent phrases of ``level`` words by their first word's place
    (0: none). Ids come from the table (_lookup) or from rows (chunk, ids: array of key and id)."""

    def known(lang: str, own) -> tuple[np.ndarray, np.ndarray]:
        if own is None:
            return table.value.get(lang, (np.zeros(0, np.int64), np.zeros(0, np.int32)))
        keys, new = (own.values.field(k).to_numpy(zero_copy_only=False) for k in ("key", "id"))
        order = np.argsort(keys)
        return keys[order], new[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            for i in range(len(batch)):
                old = np.frombuffer(columns["symbols"][i].as_buffer(), np.int32)
                keys, new = known(columns["lang"][i].as_py(), columns["ids"][i] if "ids" in columns else None)
                if level == 1:
                    codes = np.zeros(int(old.max(initial=0)) + 1, np.int32)
                    codes[keys] = new
                    symbols = codes[old]
                else:
                    symbols = np.zeros(len(old), np.int32)
                    at = np.flatnonzero((old[:-1] > 0) & (old[1:] > 0)) if len(keys) else np.zeros(0, np.int64)
                    key = old[at].astype(np.int64) << 32 | old[at + 1]
                    place = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
                    hit = keys[place] == key
                    symbols[at[hit]] = new[place[hit]]
                yield pa.RecordBatch.from_arrays([columns["chunk"].slice(i, 1), columns["lang"].slice(i, 1), pa.array([squeezed(symbols).tobytes()], pa.binary())], ["chunk", "lang", "symbols"])

    rows = chunks.select("chunk", "lang", "symbols")
    rows = rows.join(ids, "chunk") if ids is not None else rows
    return stash(rows.mapInArrow(run, "chunk long, lang string, symbols binary"), "symbols")


class Sums:
    """Counts of pairs by language, added up in sorted arrays of bounded size."""

    def __init__(self, most: int):
        self.most, self.parts, self.size, self.kept = most, {}, 0, 0

    def add(self, lang: str, keys: np.ndarray, n: np.ndarray) -> None:
        self.parts.setdefault(lang, []).append((keys, n))
        self.size += len(keys)

    def merge(self) -> None:
        """Add up the entries of equal pairs."""
        for lang, parts in self.parts.items():
            keys, n = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            self.parts[lang] = [(keys[first], np.add.reduceat(n, first))] if len(keys) else []
        self.size = sum(len(k) for parts in self.parts.values() for k, _ in parts)

    def full(self) -> bool:
        """Whether there are too many entries, after equal ones have been added up."""
        if self.size > max(self.most, 2 * self.kept):
            self.merge()
            self.kept = self.size
        return self.size > self.most // 2

    def rows(self, parts: int) -> Iterator[pa.RecordBatch]:
        """(lang, part, keys, n): the sums so far, dealt to parts by a hash of their keys, each part's in two byte strings."""
        for lang, own in self.parts.items():
            if not own:
                continue
            keys, n = (np.concatenate(x) for x in zip(*own))
            part = (mix(keys.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            keys, n, part = keys[order], n[order], part[order]
            first = np.flatnonzero(np.diff(part, prepend=-1))
            ends = np.append(first[1:], len(part))
            blobs = [pa.array([x[i:j].tobytes() for i, j in zip(first, ends)], pa.binary()) for x in (keys, n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(first), pa.string()), pa.array(part[first].astype(np.int32)), *blobs], ["lang", "part", "keys", "n"])
        self.parts, self.size, self.kept = {}, 0, 0


def _pairs(chunks: DataFrame, least: int, most: int = 1_000_000) -> DataFrame:
    """(lang, a, b, f): phrase b begins a word after phrase a f times, ``least`` or more.

    A task adds up its pairs as far as ``most`` allows and deals them to as many parts as there are shuffle partitions, by a
    hash of the pair, so frequent pairs don't meet in one part; a part's sums are added up where they arrive, and only frequent
    ones leave Python."""
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, waiting, size = Sums(most), {}, 0

        def count() -> None:
            for lang, own in waiting.items():
                a, b, n = pair_counts(*(np.concatenate(x) for x in zip(*own)))
                sums.add(lang, a << 32 | b, n)
            waiting.clear()

        for batch in batches:
            for lang, raw in zip(batch.column(0), batch.column(1)):
                symbols = np.frombuffer(raw.as_buffer(), np.int32)
                at = np.flatnonzero((symbols[:-1] > 0) & (symbols[1:] > 0))
                waiting.setdefault(lang.as_py(), []).append((symbols[at], symbols[at + 1]))
                size += len(at)
                if size >= AT_ONCE:
                    count()
                    size = 0
                    if sums.full():
                        yield from sums.rows(parts)
        count()
        sums.merge()
        yield from sums.rows(parts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(most)
        for batch in batches:
            for lang, keys, n in zip(*(batch.column(i) for i in (0, 2, 3))):
                sums.add(lang.as_py(), *(np.frombuffer(x.as_buffer(), np.int64) for x in (keys, n)))
                sums.full()
        sums.merge()
        for lang, own in sums.parts.items():
            for keys, n in own:
                hit = n >= least
                keys = keys[hit]
                columns = [pa.array([lang] * len(keys), pa.string()), pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(n[hit])]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "a", "b", "f"])

    dealt = chunks.select("lang", "symbols").mapInArrow(run, "lang string, part int, keys binary, n binary")
    return dealt.repartition(parts, "lang", "part").mapInArrow(add, "lang string, a int, b int, f long")


def _entries(chunks: DataFrame) -> DataFrame:
    """(chunk, lang, a, b): the distinct pairs of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, lang, raw in zip(*(batch.column(i) for i in range(3))):
                symbols = np.frombuffer(raw.as_buffer(), np.int32)
                at = np.flatnonzero((symbols[:-1] > 0) & (symbols[1:] > 0))
                a, b, _ = pair_counts(symbols[at], symbols[at + 1])
                yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()] * len(a), pa.int64()), pa.array([lang.as_py()] * len(a), pa.string()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["chunk", "lang", "a", "b"])

    return chunks.select("chunk", "lang", "symbols").mapInArrow(run, "chunk long, lang string, a int, b int")


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``longest`` words that occur ``least`` times in their language: (lang, words, f), and the number of
    words of each language: (lang, n). Both are stashed."""
    rows, chunks = _rows(docs, text, lang), None
    words = stash(_word_counts(rows, 16 * chunk).groupBy("lang", "a").agg(F.sum("n").alias("f")), "word-counts")
    totals = stash(words.groupBy("lang").agg(F.sum("f").alias("n")), "word-totals")
    phrases, levels, last = None, [], None
    for level in range(1, longest + 1):
        names = ["a"] if level == 1 else ["a", "b"]
        sums = words.where(F.col("f") >= least) if level == 1 else _pairs(chunks, least)
        found = stash(sums, "frequent")
        frequent = ranked(found, "lang", [-F.col("f"), *names], "id").withColumn("id", (F.col("id") + 1).cast("int"))
        drop_stash(found)
        if level == 1:
            last = frequent.select("lang", "id", F.array("a").alias("words"), "f")
        else:
            left = last.select("lang", F.col("id").alias("a"), "words")
            right = last.select("lang", F.col("id").alias("b"), F.element_at("words", -1).alias("_end"))
            last = frequent.join(left, ["lang", "a"]).join(right, ["lang", "b"]).select("lang", "id", F.concat("words", F.array("_end")).alias("words"), "f")
        last = stash(last, "phrases")
        levels.append(last)
        phrases = last if phrases is None else phrases.unionByName(last)
        if level < longest:
            old = chunks
            if frequent.count() <= SMALL:
                table = docs.sparkSession.sparkContext.broadcast(_lookup(frequent, level))
                chunks = _coded(rows, chunk, table) if level == 1 else _replaced(old, level, table)
                table.destroy()
            else:
                if level == 1:
                    old = _words(rows, chunk)
                    entries = old.select("chunk", "lang", F.posexplode("a").alias("key", "a")).withColumn("key", F.col("key").cast("long") + 1)
                else:
                    entries = _entries(old).withColumn("key", _key())
                found = entries.join(frequent.select("lang", *names, "id"), ["lang", *names])
                chunks = _replaced(old, level, ids=found.groupBy("chunk").agg(F.collect_list(F.struct("key", "id")).alias("ids")))
            drop_stash(*([old] if old is not None else []))
        drop_stash(frequent)
    drop_stash(words, *([chunks] if chunks is not None else []))
    out = stash(phrases.select("lang", "words", "f"), "all-phrases")
    drop_stash(*levels)
    return out, totals


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, top: int = 2000, chunk: int = CHUNK) -> DataFrame:
    """The ``top`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    A phrase that occurs a times is cut where floor(1000 * a * n / (l * r)) is lowest (n: words of the language; l, r:
    occurrences of the parts; the first such cut of several). Phrases inside a longer one that occurs as often are left out."""
    return rank_phrases(*frequent_phrases(docs, text, lang, least, longest, chunk), top)


def rank_phrases(phrases: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """The scores of collocations() from its counts. Products are decimals of 38 digits, so they are exact."""
    size = F.size("words")
    several = phrases.where(size >= 2)
    parts = phrases.select("lang", F.col("words").alias("part"), F.col("f").alias("_f"))
    cut = several.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cut = cut.select("*", F.slice("words", F.lit(1), F.col("k")).alias("_left"), F.slice("words", F.col("k") + 1, size - F.col("k")).alias("_right"))
    cut = cut.join(parts.select("lang", F.col("part").alias("_left"), F.col("_f").alias("l")), ["lang", "_left"])
    cut = cut.join(parts.select("lang", F.col("part").alias("_right"), F.col("_f").alias("r")), ["lang", "_right"])
    cut = cut.join(broadcast_if_small(totals), "lang")
    whole = lambda c: F.col(c).cast(T.DecimalType(19, 0))
    cut = cut.withColumns({"_up": whole("f") * whole("n") * F.lit(1000), "_down": whole("l") * whole("r")})
    scored = cut.withColumn("score", F.expr("_up div _down"))
    best = scored.groupBy("lang", "words").agg(F.min(F.struct("score", "k", "l", "r", "f", "n")).alias("b")).select("lang", "words", "b.*")
    # phrases of two and more words inside each longer one
    inner = several.where(size >= 3).select(
        "lang", "f", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("words", i, m))))).alias("words")
    )
    inner = inner.groupBy("lang", "words").agg(F.max("f").alias("_longer"))
    best = best.join(inner, ["lang", "words"], "left").where("_longer is null or _longer < f")
    named = best.withColumn("phrase", F.array_join("words", " "))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"), "phrase")
    first = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", "n", "score")


#: DuckDB twin of the query.
ORACLE = r"""
WITH p AS (SELECT COALESCE(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM p),
total AS (SELECT lang, SUM(len(ws)) AS n FROM w GROUP BY lang),
s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, ws[i:i + k - 1] AS ph FROM s, (VALUES (1), (2), (3), (4), (5)) AS t(k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, ph, COUNT(*) AS f FROM g GROUP BY lang, ph HAVING COUNT(*) >= 100),
c AS (SELECT lang, ph, f, unnest(range(1, len(ph))) AS k FROM f WHERE len(ph) > 1),
d AS (SELECT c.lang, c.ph, c.f AS a, k, x.f AS l, y.f AS r, total.n,
    (1000::HUGEINT * c.f * total.n) // (x.f::HUGEINT * y.f) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.ph = c.ph[1:k] JOIN f y ON y.lang = c.lang AND y.ph = c.ph[k + 1:len(c.ph)]
  JOIN total ON total.lang = c.lang),
e AS (SELECT * FROM d QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
m AS (SELECT lang, f, ph, unnest(range(2, len(ph))) AS m FROM f WHERE len(ph) > 2),
u AS (SELECT lang, f, m, ph, unnest(range(1, len(ph) - m + 2)) AS i FROM m),
v AS (SELECT lang, ph[i:i + m - 1] AS ph, MAX(f) AS longer FROM u GROUP BY ALL),
z AS (SELECT e.*, array_to_string(e.ph, ' ') AS phrase FROM e LEFT JOIN v ON v.lang = e.lang AND v.ph = e.ph WHERE longer IS NULL OR longer < a),
o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM o WHERE rank <= 2000
"""
