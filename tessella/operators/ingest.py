"""From files' text to chunks: pages, cleaning, sections, recursive split with overlap, dense ids."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import clean_page, estimate_tokens, norm_line, toc_like, trimmed
from tessella.operators.rows import broadcast_if_small
from tessella.sources.stash import stash

PAGE_CHARS = 3000


def paginate(docs: DataFrame, size: int = PAGE_CHARS) -> DataFrame:
    """(doc_id, page, text): form feeds part pages; else paragraphs fill pages of about size characters, and a heading
    starts a new one once the page is over half full."""
    fed = F.split("text", "\f")
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("page"))

    def add(a: Column, p: Column) -> Column:
        full = (F.length(a["page"]) + F.length(p) > size) | (p.rlike(r"^#{1,3}\s") & (F.length(a["page"]) > size / 2))
        close = full & (a["page"] != "")
        return F.struct(
            F.when(close, F.concat(a["done"], F.array(a["page"]))).otherwise(a["done"]).alias("done"),
            F.concat(F.when(close, "").otherwise(a["page"]), p, F.lit("\n\n")).alias("page"),
        )

    last = lambda a: F.concat(a["done"], F.when(trimmed(a["page"]) != "", F.array(a["page"])).otherwise(F.array().cast("array<string>")))
    filled = F.transform(F.aggregate(F.split("text", r"\n{2,}"), zero, add, last), trimmed)
    pages = F.when(F.col("text").contains("\f"), fed).otherwise(filled)
    return docs.select("doc_id", F.posexplode(pages).alias("page", "text")).withColumn("page", F.col("page") + 1)


def boilerplate(pages: DataFrame, share: float = 0.3, least: int = 5) -> DataFrame:
    """(doc_id, line, pages): normalised lines of 4 to 160 characters on at least max(3, share) of a document's pages."""
    return _repeated(_lines(pages), pages, share, least)


def _lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page, pos, raw, line): each line as it is and normalised; the licence marks are taken out of the text
    that stays, but the lines are counted as they were."""
    return pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).withColumn("line", norm_line(F.col("raw")))


def _repeated(lines: DataFrame, pages: DataFrame, share: float, least: int) -> DataFrame:
    some = lines.where(F.length("line").between(4, 160)).select("doc_id", "page", "line").distinct()
    counted = some.groupBy("doc_id", "line").agg(F.count("*").alias("pages"))
    sizes = pages.groupBy("doc_id").agg(F.count("*").alias("n"))
    kept = counted.join(sizes, "doc_id").where((F.col("n") >= least) & (F.col("pages") >= F.greatest(F.lit(3), F.ceil(F.col("n") * share))))
    return kept.select("doc_id", "line", "pages")


def clean_pages(pages: DataFrame, share: float = 0.3, least: int = 5, min_chars: int = 50) -> DataFrame:
    """(doc_id, page, text, chars_before, kept) of each page. A document's boilerplate lines, of which each page has few, join
    its pages as one array, so that pages are cleaned within their rows and no line or text is exchanged for it."""
    gone = boilerplate(pages, share, least).groupBy("doc_id").agg(F.collect_list("line").alias("_gone"))
    rows = pages.join(broadcast_if_small(stash(gone, "boilerplate")), "doc_id", "left")
    text = F.when(F.col("_gone").isNull(), clean_page(F.col("text"))).otherwise(clean_page(F.col("text"), F.col("_gone")))
    cleaned = rows.select("doc_id", "page", text.alias("text"), F.length("text").alias("chars_before"))
    return cleaned.withColumn("kept", F.length("text") > min_chars)


def clean_stats(cleaned: DataFrame) -> DataFrame:
    """Per document: pages in and kept, characters before and removed, share removed, tokens."""
    kept = F.col("kept")
    after = F.sum(F.when(kept, F.length("text")).otherwise(0))
    before = F.sum("chars_before")
    return cleaned.groupBy("doc_id").agg(
        F.count("*").alias("pages_in"),
        F.count_if(kept).alias("pages_kept"),
        before.cast("bigint").alias("chars_before"),
        (before - after).cast("bigint").alias("chars_removed"),
        F.round(F.when(before > 0, (before - after) / before).otherwise(0.0), 6).alias("removed_share"),
        F.sum(F.when(kept, estimate_tokens(F.col("text"))).otherwise(0)).cast("bigint").alias("tokens"),
    )


def carry_sections(pages: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, line, section): the last "## " heading above each line, across pages."""
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    heading = F.regexp_extract(trimmed(F.col("line")), r"^##\s+(.+)$", 1)
    title = F.when(heading != "", F.substring(trimmed(heading), 1, 120))
    order = Window.partitionBy("doc_id").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("title", title).withColumn("section", F.coalesce(F.last("title", ignorenulls=True).over(order), F.lit("")))
    return rows.select("doc_id", "page", "line_no", "line", "section", F.col("title").isNotNull().alias("is_heading"))


SEPARATORS = ("\n\n", "\n", ". ", " ")


def _tokens(text: str) -> int:
    if not text:
        return 0
    words = len(re.split(r"\s+", text.strip()))
    return max(int(len(text) / 4 + 0.5), int(words * 1.25 + 0.5))


def _pieces(text: str, size: int, level: int = 0) -> list[str]:
    """Parts of at most size tokens at the coarsest separators that give them; each part keeps its separator."""
    if _tokens(text) <= size:
        return [text]
    if level == len(SEPARATORS):
        return [text[i : i + 4 * size] for i in range(0, len(text), 4 * size)]
    mark = SEPARATORS[level]
    cut = text.split(mark)
    if len(cut) == 1:
        return _pieces(text, size, level + 1)
    out: list[str] = []
    for part in [*(c + mark for c in cut[:-1]), cut[-1]]:
        if part.strip():
            out += _pieces(part, size, level + 1)
    return out


def split_text(text: str, size: int = 400, overlap: int = 50) -> list[str]:
    """Chunks of at most size tokens, each beginning with up to overlap tokens of the one before."""
    chunks: list[str] = []
    window: list[tuple[str, int]] = []
    held = 0
    for piece in _pieces(text, size):
        n = _tokens(piece)
        if window and held + n > size:
            chunks.append("".join(p for p, _ in window).strip())
            while window and (held > overlap or held + n > size):
                held -= window.pop(0)[1]
        window.append((piece, n))
        held += n
    if window:
        chunks.append("".join(p for p, _ in window).strip())
    return [c for c in chunks if c]


def chunk_pages(pages: DataFrame, size: int = 400, overlap: int = 50, min_tokens: int = 8) -> DataFrame:
    """(doc_id, page, pos, section, text, tokens, idx): idx is dense within the document and null for dropped chunks
    (short, index-like, or repeated within the document)."""

    @F.arrow_udf("array<string>")
    def split(column: pa.Array) -> pa.Array:
        return pa.array([split_text(t or "", size, overlap) for t in column.to_pylist()], pa.list_(pa.string()))

    rows = carry_sections(pages)
    # a segment is a run of lines below one heading of one page
    order = Window.partitionBy("doc_id").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("seg", F.sum(F.col("is_heading").cast("int")).over(order)).where(~F.col("is_heading"))
    segments = rows.groupBy("doc_id", "page", "seg", "section").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("x"))
    segments = segments.withColumn("text", F.array_join(F.transform("x", lambda x: x["line"]), "\n")).where(trimmed(F.col("text")) != "")
    chunks = segments.select("doc_id", "page", "seg", "section", F.posexplode(split("text")).alias("part", "text"))
    chunks = chunks.withColumn("tokens", estimate_tokens(F.col("text")))
    same = F.md5(F.lower(F.regexp_replace("text", r"\s+", " ")).cast("binary"))  # the key of the window, in place of the text
    first = Window.partitionBy("doc_id", same).orderBy("page", "seg", "part")
    ok = (F.col("tokens") >= min_tokens) & ~toc_like(F.col("text"))
    chunks = chunks.withColumn("ok", ok)
    # only chunks that count can be repeated later
    chunks = chunks.withColumn("ok", F.col("ok") & (F.sum(F.col("ok").cast("int")).over(first.rowsBetween(Window.unboundedPreceding, 0)) == 1))
    dense = Window.partitionBy("doc_id").orderBy("page", "seg", "part").rowsBetween(Window.unboundedPreceding, 0)
    idx = F.when(F.col("ok"), F.sum(F.col("ok").cast("int")).over(dense) - 1)
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "seg", "part"))
    return chunks.select("doc_id", "page", pos.alias("pos"), "section", "text", "tokens", idx.cast("int").alias("idx"))


def describe_chunks(chunks: DataFrame) -> DataFrame:
    """Per document: kept chunks, rounded mean, min, median (nearest rank), max of tokens, sections, dropped."""
    kept = F.col("idx").isNotNull()
    value = F.when(kept, F.col("tokens"))
    ranked = chunks.withColumn("r", F.when(kept, F.row_number().over(Window.partitionBy("doc_id", kept).orderBy("tokens", "pos"))))
    ranked = ranked.withColumn("n", F.count_if(kept).over(Window.partitionBy("doc_id")))
    middle = F.max(F.when(F.col("r") == F.least(F.col("n"), F.floor(F.col("n") * 0.5) + 1), F.col("tokens")))
    return ranked.groupBy("doc_id").agg(
        F.count_if(kept).alias("chunks"),
        F.floor(F.avg(value) + 0.5).alias("mean_tokens"),
        F.min(value).alias("min_tokens"),
        middle.alias("median_tokens"),
        F.max(value).alias("max_tokens"),
        F.count_distinct(F.when(kept & (F.col("section") != ""), F.col("section"))).alias("sections"),
        F.count_if(~kept).alias("dropped"),
    )
