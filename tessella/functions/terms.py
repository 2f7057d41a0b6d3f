"""Indexed terms and estimates of whole texts, counted in batches: the rules of text.tokens and text.estimate_tokens, for texts by
the million."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import SPACE, STOPWORDS

TERMS = "array<struct<term: string, tf: bigint>>"
#: text.WORD: letters and digits are what \w has besides the underscore.
WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
MARKS = re.compile("[\u0300-\u036f]+")
BASIC = re.compile("[\u0080-\uffff]+")
#: Neither ASCII nor a mark that folding takes away.
OTHER = re.compile("[^\x00-\x7f\u0300-\u036f]")
HIGHER = re.compile("[\U00010000-\U0010ffff]")
STOP = frozenset(STOPWORDS)
#: Of ASCII what may stand in a word of WORD stays, all else becomes a blank.
APART = {c: chr(c) if chr(c).isalnum() or chr(c) in "'-" else " " for c in range(128)}
SPACES = re.compile(f"{SPACE}+")
#: What only one of str.split and text.SPACE counts as white space.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\ufeff]")
#: Rows of a batch that a task gives back.
ROWS = 1_000


def folded(text: str) -> str:
    """text.fold of one text: characters above the basic plane stay as they are."""
    if not text.isascii():
        if HIGHER.search(text):
            text = BASIC.sub(lambda m: MARKS.sub("", unicodedata.normalize("NFKD", m[0])), text)
        else:
            text = unicodedata.normalize("NFKD", text)
            text = MARKS.sub("", text) if OTHER.search(text) else text.encode("ascii", "ignore").decode("ascii")
        text = text.replace("ß", "ss")
    return text.lower()


def word_counts(text: str) -> Counter[str]:
    """Words of a folded text as WORD finds them, with their numbers: ASCII is cut at blanks, which is faster, and only pieces with
    apostrophes or hyphens go through the pattern."""
    if not text.isascii():
        return Counter(WORD.findall(text))
    words = Counter(text.translate(APART).split())
    for piece in [w for w in words if not w.isalnum()]:
        n = words.pop(piece)
        for word in WORD.findall(piece):
            words[word] += n
    return words


def counts_of(text: str | None) -> dict[str, int]:
    """text.tokens of one text with their numbers."""
    out = word_counts(folded(text or ""))
    for word in [w for w in out if not w.isalnum()]:
        n = out.pop(word)
        word = re.sub("['’]", "", re.sub("['’]s$", "", word))
        for w in [word.replace("-", ""), *word.split("-")] if "-" in word else [word]:
            out[w] += n
    for w in [w for w in out if len(w) < 2 or w in STOP]:
        del out[w]
    return out


def term_counts(rows: DataFrame, kept: tuple[str, ...], text: Column) -> DataFrame:
    """(kept.., dl, terms): number of terms and (term, tf) of each row's text, counted within the row."""
    types = dict(rows.dtypes)
    schema = ", ".join(f"`{n}` {types[n]}" for n in kept) + f", dl bigint, terms {TERMS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                terms, times, ends, lengths = [], [], [0], []
                for value in batch.column(len(kept)).to_pylist():
                    counts = counts_of(value)
                    terms += counts
                    times += counts.values()
                    ends.append(len(terms))
                    lengths.append(sum(counts.values()))
                entries = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(times, pa.int64())], ["term", "tf"])
                columns = [batch.column(i) for i in range(len(kept))]
                columns += [pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "dl", "terms"])

    return rows.select(*kept, text.alias("_text")).mapInArrow(run, schema)


def estimate_of(text: str | None) -> int:
    """text.estimate_tokens of one text."""
    if not text:
        return 0
    words = len(SPACES.split(text.strip(SPACE[1:-1]))) if ODD_SPACE.search(text) else len(text.split()) or 1
    return max(int(len(text) / 4 + 0.5), int(words * 1.25 + 0.5))


def estimated(text: Column) -> Column:
    """text.estimate_tokens without a pattern's steps for every character."""

    @F.arrow_udf("int")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([estimate_of(t.as_py()) for t in column], pa.int32())

    return run(text)
