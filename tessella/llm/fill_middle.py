"""Fill-in-the-middle: a text is cut twice at unit ends and its parts are put in another order behind sentinels.

The code points of a block of whole texts become character classes in one wavelet matrix. A unit ends behind each
character of its boundary classes (and at the text's end), so the rank queries of these classes add up to a text's
number of units, and select (one class) or bisection on the summed ranks (several) gives the place of a cut. Only the
two cuts leave Python; Spark's own string functions build and restore the texts.

Draws come from the digits of sha256("<seed>:<key>"): cuts after h1 and h2 modulo (units + 1) units, the plain form from h3,
the order from h4. So a row's result depends on its key and text only, in any order of rows.

Defined cases: a null text is an empty one and stays plain, as does a text that holds a sentinel (nothing could be restored
exactly); a null key draws as an empty string; repeated rows give the same result; texts of any length are processed
whole; an empty table gives an empty table; input columns named like a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.wavelet import WaveletMatrix
from tessella.llm.wordhash import texts

LINE, RETURN, SPACE, SENTENCE, MARK, DIGIT, LETTER, OTHER = range(8)
#: The classes whose characters end a unit.
UNITS = {
    "line": (LINE,),
    "word": (LINE, RETURN, SPACE),
    "sentence": (LINE, SENTENCE),
    "char": tuple(range(8)),
}
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def class_of_lead_byte() -> np.ndarray:
    """Class of a code point by the first byte of its UTF-8 form."""
    out = np.full(256, OTHER, np.uint8)
    for b in range(128):
        c = chr(b)
        out[b] = LETTER if c.isalpha() else DIGIT if c.isdigit() else MARK
    out[[0x0B, 0x0C, 0x0D]] = RETURN
    out[[0x20, 0x09]] = SPACE
    out[[ord(c) for c in ".!?"]] = SENTENCE
    out[0x0A] = LINE
    return out


_CLASS = class_of_lead_byte()


def cut_places(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray, ends: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """Units, and code points before the first and the second cut, of each text (UTF-8 bytes and their offsets)."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    classes = _CLASS[data[lead]]
    at = np.searchsorted(lead, offsets)
    start, end = at[:-1], at[1:]
    matrix = WaveletMatrix(classes, 3)
    before = matrix.rank_all(ends, at)
    closed = before[1:] - before[:-1]
    full = end > start
    is_end = np.isin(np.arange(8), ends)
    last = np.zeros(len(start), bool)
    last[full] = is_end[classes[end[full] - 1]]
    n = closed + (full & ~last)
    cuts = []
    for k in (np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))):
        place = np.where(k == 0, 0, end - start)
        inner = (k > 0) & (k < n)
        if inner.any():
            place[inner] = matrix.select_all(ends, before[:-1][inner] + k[inner] - 1) + 1 - start[inner]
        cuts.append(place)
    return n, cuts[0], cuts[1]


def cuts(text: Column, h1: Column, h2: Column, unit: str) -> Column:
    """struct<n, a, b>: units of the text, and code points before its first and second cut."""
    ends = UNITS[unit]

    @F.arrow_udf("struct<n: long, a: long, b: long>")
    def run(column: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        h1, h2 = (np.asarray(x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x).astype(np.int64) for x in (first, second))
        found = [np.zeros((3, 0), np.int64)]
        for i, data, offsets in texts(column):
            m = len(offsets) - 1
            found.append(np.stack(cut_places(data, offsets, h1[i : i + m], h2[i : i + m], ends)))
        return pa.StructArray.from_arrays([pa.array(x) for x in np.concatenate(found, axis=1)], ["n", "a", "b"])

    return run(text, h1, h2)


def draws(key: Column, seed: str) -> list[Column]:
    """Four unsigned 32-bit draws of a row."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "line", seed: str = "7", rate: int = 100, spm_rate: int = 50
) -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix_chars, middle_chars (null where plain) and output.

    ``rate`` percent of the texts are transformed, of these ``spm_rate`` percent with the suffix first."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    h1, h2, h3, h4 = draws(F.col(key), seed)
    drawn = docs.withColumns({"_text": whole, "_h3": h3, "_h4": h4, "_cut": cuts(whole, h1, h2, unit)})
    holds = F.lit(False)
    for sentinel in SENTINELS:
        holds = holds | F.col("_text").contains(sentinel)
    plain = (F.col("_text") == "") | holds | (F.col("_h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("_h4") % 100 < spm_rate, "spm").otherwise("psm")
    a, b = F.col("_cut.a").cast("int"), F.col("_cut.b").cast("int")
    prefix = F.substring("_text", F.lit(1), a)
    middle = F.substring("_text", a + 1, b - a)
    suffix = F.substring("_text", b + 1, F.length("_text") - b)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    shaped = drawn.withColumn("_form", form)
    moved = F.col("_form") != "plain"
    made = shaped.withColumns(
        {
            "n": F.col("_cut.n"),
            "form": F.col("_form"),
            "prefix_chars": F.when(moved, F.col("_cut.a")),
            "middle_chars": F.when(moved, F.col("_cut.b") - F.col("_cut.a")),
            "output": F.when(~moved, F.col("_text")).when(F.col("_form") == "psm", psm).otherwise(spm),
        }
    )
    return made.select(*[c for c in docs.columns if c not in RESULTS], *RESULTS)


def restore(output: Column, form: Column) -> Column:
    """The text that an output of the given form was made from."""
    parts = F.split(output, "<[PSM]>", -1)
    part = lambda i: F.element_at(parts, i)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(2), part(4), part(3))).otherwise(F.concat(part(3), part(4), part(2)))


def digest(made: DataFrame, key: str = "doc_id") -> DataFrame:
    """The result with SHA-256 sums in place of texts; the restored text is rebuilt from output and form alone."""
    return made.select(
        key, "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


#: DuckDB twin of the query with lines as units.
ORACLE = """
WITH t AS (SELECT doc_id, COALESCE(text, '') AS text, sha256('7:' || COALESCE(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, string_split(text, chr(10)) AS parts,
    ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
v AS (SELECT *, len(parts) - (CASE WHEN parts[-1] = '' THEN 1 ELSE 0 END) AS n FROM u),
w AS (SELECT *, LEAST(h1 % (n + 1), h2 % (n + 1)) AS i, GREATEST(h1 % (n + 1), h2 % (n + 1)) AS j FROM v),
x AS (SELECT *,
    CASE WHEN i = 0 THEN '' WHEN i = n THEN text ELSE array_to_string(parts[1:i], chr(10)) || chr(10) END AS head,
    CASE WHEN j = 0 THEN '' WHEN j = n THEN text ELSE array_to_string(parts[1:j], chr(10)) || chr(10) END AS upto,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM w),
y AS (SELECT *, substr(upto, length(head) + 1) AS middle, substr(text, length(upto) + 1) AS tail FROM x)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(head) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || middle
    ELSE '<S>' || tail || '<P>' || head || '<M>' || middle END) AS output_sha256,
  sha256(head || middle || tail) AS restored_sha256
FROM y
"""
