"""Paged reading: the rendered items of a range of lines, up to a budget of bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidlog.functions.text import cut_bytes

BUDGET = 61_440 - 64


def line_blocks(items: DataFrame) -> DataFrame:
    """``archive_path, line, items`` -> one text block per line that has items."""
    each = F.transform("items", lambda x: F.concat(F.lit("L"), F.col("line").cast("string"), F.lit(" "), x, F.lit("\n\n")))
    return items.where(F.size("items") > 0).select("archive_path", "line", F.array_join(each, "").alias("block"))


def pages(items: DataFrame, start: int = 1, end: int | None = None, budget: int = BUDGET) -> DataFrame:
    """The first page of every file from ``start``: line, block, and whether another line follows.

    Lines come in while the running total of bytes fits; if the very first doesn't, it is cut to fit, so that
    reading always goes on.  ``next_line`` is where to continue, null at the end.
    """
    inside = items.where((F.col("line") >= max(1, start)) & (F.lit(end).isNull() | (F.col("line") <= F.lit(end).cast("long"))))
    w = Window.partitionBy("archive_path").orderBy("line")
    run = line_blocks(inside).withColumns({
        "total": F.sum(F.octet_length("block")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "nth": F.row_number().over(w),
        "next_line": F.lead("line").over(w),
    })
    shown = run.where((F.col("total") <= budget) | (F.col("nth") == 1))
    block = F.when(F.col("total") > budget, cut_bytes(F.col("block"), budget - 16)).otherwise(F.col("block"))
    last = Window.partitionBy("archive_path")
    return shown.select("archive_path", "line", block.alias("block"), F.max_by("next_line", "line").over(last).alias("next_line"))


def page_text(page: DataFrame) -> DataFrame:
    """One row per file: the page with its pointer to the next line."""
    rows = F.array_sort(F.collect_list(F.struct("line", "block")))
    text = F.array_join(F.transform(rows, lambda r: r["block"]), "")
    more = F.when(F.col("next_line").isNotNull(), F.concat(F.lit("_(continue with startLine="), F.col("next_line").cast("string"), F.lit(")_"))).otherwise("")
    return page.groupBy("archive_path", "next_line").agg(text.alias("text")).select("archive_path", F.concat("text", more).alias("text"))
