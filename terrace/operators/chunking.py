"""Cutting documents into chapters: sections by a small function for each text, sizes and windows as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions import markdown
from terrace.functions.text import estimate_tokens, sanitize_path_part, strip_text

RUNES = 4  # characters that a window counts for a token
PIECES = "array<struct<titles: array<string>, text: string, preamble: string>>"
Splitter = Callable[[str | None, int], list[markdown.Piece]]


def window_count(text: Column, budget: int, stride: int) -> Column:
    """How many windows a text takes: one if it fits the budget of estimated tokens or the width of a window."""
    wide, step = budget * RUNES, max(1, min(stride, budget)) * RUNES
    many = F.lit(1) + F.ceil((F.length(text) - wide) / F.lit(step))
    return F.when((estimate_tokens(text) <= budget) | (F.length(text) <= wide), F.lit(1)).otherwise(many).cast("int")


def sliding_windows(df: DataFrame, text_col: str, *, budget: int = 512, stride: int = 100) -> DataFrame:
    """Each row once for each window of its trimmed text: adds ``window`` (from 1), ``windows`` and ``chunk``.

    Windows are ``4 * budget`` characters wide and begin ``4 * stride`` apart; the last reaches the text's end. Null
    and blank texts give no rows.
    """
    step, wide = max(1, min(stride, budget)) * RUNES, budget * RUNES
    sized = df.withColumn("chunk", strip_text(F.col(text_col))).filter("chunk <> ''").withColumn("windows", window_count(F.col("chunk"), budget, stride))
    each = sized.withColumn("window", F.explode(F.sequence(F.lit(1), F.col("windows"))))
    return each.withColumn("chunk", F.when(F.col("windows") == 1, F.col("chunk")).otherwise(F.expr(f"substring(chunk, (window - 1) * {step} + 1, {wide})")))


def _section_batches(budget: int, splitter: Splitter):
    kind = pa.list_(pa.struct([("titles", pa.list_(pa.string())), ("text", pa.string()), ("preamble", pa.string())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                cuts = [[dict(zip(("titles", "text", "preamble"), p)) for p in splitter(t.as_py(), budget)] for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cuts, kind)], ["document_id", "doc_title", "pieces"])

    return cut


def split_chapters(df: DataFrame, id_col: str, title_col: str, text_col: str, *, budget: int = 512, stride: int = 100, splitter: Splitter = markdown.pieces) -> DataFrame:
    """``document_id, ordinal, path, title, content, tokens`` for each chapter of each document.

    The path joins the document's id with the titles above the chapter and, where a chapter was cut into windows,
    the window's number; ``__root__`` stands for missing titles then, the document's title (or ``body``) for missing
    titles of a whole text. A document without text has one chapter with empty content. ``splitter`` may replace the
    way in which sections are found. Rows without id are left out; other columns are not read.
    """
    source = df.select(F.col(id_col).cast("string").alias("document_id"), F.col(title_col).cast("string").alias("doc_title"), F.col(text_col).alias("text")).filter("document_id IS NOT NULL")
    cut = source.mapInArrow(_section_batches(budget, splitter), f"document_id string, doc_title string, pieces {PIECES}")
    rows = cut.select("document_id", "doc_title", F.posexplode_outer("pieces").alias("piece", "p")).select("document_id", "doc_title", F.coalesce("piece", F.lit(0)).alias("piece"), "p.titles", F.coalesce("p.preamble", F.lit("")).alias("preamble"), strip_text(F.coalesce("p.text", F.lit(""))).alias("text"))
    step, wide = max(1, min(stride, budget)) * RUNES, budget * RUNES
    rows = rows.withColumn("windows", window_count(F.col("text"), budget, stride)).withColumn("window", F.explode(F.sequence(F.lit(1), "windows")))
    many = F.col("windows") > 1
    chunk = F.when(many, F.expr(f"substring(text, (window - 1) * {step} + 1, {wide})")).otherwise(F.col("text"))
    first = (F.col("window") == 1) & (F.col("preamble") != "")
    content = strip_text(F.when(first, F.concat_ws("\n\n", "preamble", chunk)).otherwise(chunk))
    titles = F.coalesce("titles", F.array().cast("array<string>"))
    below = F.when(F.size(titles) > 0, F.array_join(titles, "/")).when(many, F.lit("__root__")).otherwise(sanitize_path_part(F.coalesce("doc_title", F.lit(""))))
    path = F.concat_ws("/", "document_id", below, F.when(many, F.col("window").cast("string")))
    out = rows.select("document_id", "piece", "window", path.alias("path"), F.coalesce(F.try_element_at(titles, F.lit(-1)), "doc_title").alias("title"), content.alias("content"))
    ordinal = F.col("piece").cast("bigint") * 1_000_000 + F.col("window")  # in the order of the text
    return out.select("document_id", ordinal.alias("ordinal"), "path", "title", "content", estimate_tokens(F.col("content")).alias("tokens"))


def last_by_path(chapters: DataFrame) -> DataFrame:
    """One chapter for each path: of headings that repeat, the last in the text."""
    return chapters.groupBy("document_id", "path").agg(F.max_by(F.struct("ordinal", "title", "content", "tokens"), "ordinal").alias("c")).select("document_id", "path", "c.*")
