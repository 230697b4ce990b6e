"""Exchanges folded from line facts: one user message with the answers and tool calls until the next.

A running count of start lines, in blocks of lines, numbers the segments of a file; each segment is one row after
one aggregation.  Lines before the first start belong to none; bad lines only move ``line_end``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidlog.functions.text import project_of
from braidlog.session import cut

MOST_BYTES = 262_144
#: Lines of one file that are counted in one task.
BLOCK = 65_536


def segments(facts: DataFrame, long: bool | None = None) -> DataFrame:
    """Line facts with the number of their exchange within the file (0: before the first).

    Where no file has ``BLOCK`` lines (``long`` false; null: looked up, which reads line numbers only) one window over
    each file counts, and its partitioning serves the fold behind it.  Else files are counted in blocks of ``BLOCK`` lines,
    each a task's work at most, and the starts in the blocks before are added; only the facts that this needs are read again.
    """
    if long is None:
        long = not facts.select("line").where(F.col("line") >= BLOCK).isEmpty()
    if not long:
        w = Window.partitionBy("archive_path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return facts.withColumn("segment", F.sum(F.when(F.col("start_text").isNotNull(), 1).otherwise(0)).over(w))
    key = ["archive_path", "block"]
    df = facts.withColumn("block", F.floor(F.col("line") / BLOCK))
    is_start = F.when(F.col("start_text").isNotNull(), 1).otherwise(0)
    large = facts.where(F.col("line") >= BLOCK).select("archive_path").distinct()
    per = df.join(large, "archive_path", "left_semi").groupBy(*key).agg(F.sum(is_start).alias("starts"))
    earlier = Window.partitionBy("archive_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select(*key, F.coalesce(F.sum("starts").over(earlier), F.lit(0)).alias("before"))
    here = Window.partitionBy(*key).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = df.withColumn("here", F.sum(is_start).over(here)).join(before, key, "left")
    return counted.withColumn("segment", F.col("here") + F.coalesce("before", F.lit(0))).drop("here", "before", "block")


def _joined(parts: Column) -> Column:
    """Parts joined by a blank line; one is put only behind something, so an empty first part adds none."""
    return F.aggregate(parts, F.lit(""), lambda out, x: F.when(out == "", x).otherwise(F.concat(out, F.lit("\n\n"), x)))


def _ordered(column: str) -> Column:
    """The values of an array column over a segment, in line order."""
    rows = F.array_sort(F.collect_list(F.when(F.size(column) > 0, F.struct("line", F.col(column).alias("x")))))
    return F.flatten(F.transform(rows, lambda r: r["x"]))


def folded(facts: DataFrame, long: bool | None = None) -> DataFrame:
    """All exchanges, unanswered ones too: bounds, texts, distinct tools in first-seen order."""
    seg = segments(facts, long).where("segment > 0")
    out = seg.groupBy("archive_path", "segment").agg(
        F.min("line").alias("line_start"),
        F.max("line").alias("line_end"),
        F.min_by("ts", "line").alias("ts"),
        F.max("start_text").alias("user_message"),
        _ordered("answer_parts").alias("answers"),
        _ordered("fallback_parts").alias("fallbacks"),
        F.array_distinct(_ordered("tool_parts")).alias("tool_names"),
        F.count_if("is_bad").alias("bad_lines"),
    )
    answer, spare = _joined(F.col("answers")), _joined(F.col("fallbacks"))
    out = out.withColumn("assistant_message", F.when(answer != "", answer).otherwise(spare))
    return out.drop("answers", "fallbacks")


def answered(exchanges: DataFrame) -> DataFrame:
    """Exchanges with an answer or a tool call."""
    return exchanges.where((F.col("assistant_message") != "") | (F.size("tool_names") > 0))


def opted_out(exchanges: DataFrame, marker: str) -> DataFrame:
    """Archive paths with an exchange whose user message holds the marker; a mere part of it in a quotation doesn't count."""
    return exchanges.where(F.contains("user_message", F.lit(marker))).select("archive_path").distinct()


def purged(exchanges: DataFrame, marker: str, skipped: DataFrame | None = None) -> DataFrame:
    """Exchanges without those of files that opted out, now or (``skipped``) before."""
    out = opted_out(exchanges, marker)
    if skipped is not None:
        out = out.unionByName(skipped.select("archive_path")).distinct()
    return exchanges.join(out, "archive_path", "left_anti")


def fits(most: int = MOST_BYTES) -> Column:
    """Whether neither message has more than ``most`` bytes; a missing answer has none."""
    return (F.octet_length("user_message") <= most) & (F.coalesce(F.octet_length("assistant_message"), F.lit(0)) <= most)


def byte_starts(lines: DataFrame, text: str) -> DataFrame:
    """Lines of files with ``byte_start``, the bytes of all lines before in the file, line feeds included."""
    w = Window.partitionBy("archive_path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("byte_start", F.coalesce(F.sum(F.octet_length(text) + 1).over(w), F.lit(0)))


def indexed(exchanges: DataFrame, meta: DataFrame, harness: str, marker: str, skipped: DataFrame | None = None) -> DataFrame:
    """Answered exchanges with the facts of their file, without oversized ones and files that opted out.

    ``skipped``: archive paths known to have opted out before; opting out is for good.
    """
    kept = answered(purged(exchanges, marker, skipped)).where(fits())
    kept = kept.join(meta.select("archive_path", "session_id", "cwd", "is_sidechain"), "archive_path", "left")
    return kept.select(
        "archive_path", "line_start", "line_end", "session_id", project_of(F.col("cwd")).alias("project"), F.lit(harness).alias("harness"), F.coalesce("is_sidechain", F.lit(False)).alias("is_sidechain"), "ts", "user_message", "assistant_message", "tool_names"
    )


def numbered(exchanges: DataFrame, after: int = 0) -> DataFrame:
    """With ids above ``after`` in the order of (archive_path, line_start): newer ones are larger.

    Numbers come from a range sort and counts per partition; nothing is gathered into one task.  The sorted rows are
    written before they are counted, so a partition lost and computed again keeps its numbers.
    """
    order = ["archive_path", "line_start"]
    ranged = cut(exchanges.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    local = ranged.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    counts = local.groupBy("part").agg(F.max("n").alias("size"))
    offsets = counts.withColumn("offset", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "offset")
    return local.join(offsets, "part").withColumn("id", (F.col("n") + F.col("offset") + after).cast("long")).drop("part", "n", "offset")


def resume_points(exchanges: DataFrame) -> DataFrame:
    """Line at which each file is parsed again when it grows: the start of its last exchange."""
    return exchanges.groupBy("archive_path").agg(F.max("line_start").alias("reparse_line"))


def without_suffix(exchanges: DataFrame, cuts: DataFrame) -> DataFrame:
    """Exchanges without those at or behind ``from_line`` of the files in ``cuts``."""
    return exchanges.join(cuts.select("archive_path", "from_line"), "archive_path", "left").where("from_line is null or line_start < from_line").drop("from_line")


def embedding_text(user: Column, assistant: Column, tools: Column, most: int = 2000) -> Column:
    """What an embedder reads of an exchange."""
    text = F.concat(F.lit("User: "), user, F.lit("\n\nAssistant: "), assistant, F.lit("\n\nTools: "), F.array_join(tools, ","))
    return F.concat(F.lit("passage: "), F.substring(text, 1, most))
