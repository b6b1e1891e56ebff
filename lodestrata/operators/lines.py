"""Outline, text lines and line reconstruction over chunk rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import contains_ignoring_case, is_aligned, strip


def _file(chunks: DataFrame) -> list[str]:
    """The columns that tell files apart: several repositories may hold equal paths."""
    return [c for c in ("repo", "path") if c in chunks.columns]


def outline(chunks: DataFrame) -> DataFrame:
    """Per path, neighbours with the same symbol (not null) and kind become one entry."""
    order = Window.partitionBy(*_file(chunks)).orderBy("start_line", "chunk_id")
    same = F.coalesce(
        F.col("symbol").isNotNull() & (F.lag("symbol").over(order) == F.col("symbol")) & F.lag("chunk_kind").over(order).eqNullSafe(F.col("chunk_kind")),
        F.lit(False),
    )
    numbered = chunks.withColumn("__new", F.when(same, 0).otherwise(1)).withColumn("__island", F.sum("__new").over(order))
    return numbered.groupBy(*_file(chunks), "__island").agg(
        F.first("symbol").alias("symbol"), F.first("chunk_kind").alias("chunk_kind"),
        F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"),
    ).drop("__island")


def aligned(chunks: DataFrame) -> DataFrame:
    """Add ``aligned``: the chunk's text lines are its source lines."""
    fits = is_aligned(F.col("text"), F.col("start_line"), F.col("end_line"))
    if "grouped" in chunks.columns:
        fits = fits & ~F.coalesce("grouped", F.lit(False))
    return chunks.withColumn("aligned", fits)


def matching_lines(chunks: DataFrame, needle: str) -> DataFrame:
    """Lines that hold the needle, once per (path, line number, stripped text)."""
    file = _file(chunks)
    lines = aligned(chunks).select(*file, "start_line", "chunk_id", "aligned", F.posexplode(F.split("text", "\n", -1)).alias("offset", "line"))
    found = lines.where(contains_ignoring_case(F.col("line"), needle)).select(
        *file, F.when(F.col("aligned"), F.col("start_line") + F.col("offset")).otherwise(F.col("start_line")).alias("line_number"),
        strip(F.col("line")).alias("text"), F.col("aligned").alias("exact_line"), F.struct("start_line", "chunk_id", "offset").alias("__order"),
    )
    return found.groupBy(*file, "line_number", "text").agg(F.min_by("exact_line", "__order").alias("exact_line"))


def source_lines(chunks: DataFrame, start_line: int | None = None, end_line: int | None = None) -> DataFrame:
    """(path, line_number, text) from aligned chunks; the chunk that starts later wins."""
    file = _file(chunks)
    lines = aligned(chunks).where("aligned").select(*file, "start_line", "chunk_id", F.posexplode(F.split("text", "\n", -1)).alias("offset", "text"))
    lines = lines.withColumn("line_number", F.col("start_line") + F.col("offset"))
    if start_line is not None:
        lines = lines.where(F.col("line_number") >= start_line)
    if end_line is not None:
        lines = lines.where(F.col("line_number") <= end_line)
    return lines.groupBy(*file, "line_number").agg(F.max_by("text", F.struct("start_line", "chunk_id")).alias("text"))
