"""Keyword and vector ranks merged on an absolute scale from 0 to 1."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, KEYWORD, VECTOR, PENALTY = 60, 0.4, 0.6, 0.9
#: What the first, the second and the third keyword rank get besides (fixed values).
BONUS = {1: 0.01, 2: 0.005, 3: 0.0025}
BEST = KEYWORD / (K + 1) + BONUS[1] + VECTOR / (K + 1)


def ranked_again(rows: DataFrame, by: str) -> DataFrame:
    """Ranks of what is left of a list of retrieved rows."""
    return rows.drop("rank").withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), F.asc("id"))))  # as few rows as were retrieved


def without_session(rows: DataFrame, exchanges: DataFrame, session: str | None) -> DataFrame:
    """Retrieved rows without those of the asking session; rows without a session stay."""
    return rows if session is None else rows.join(exchanges.where(F.col("session_id") == session).select("id"), "id", "left_anti")


def keyword_part(rank: Column) -> Column:
    bonus = F.when(rank == 1, BONUS[1]).when(rank == 2, BONUS[2]).when(rank == 3, BONUS[3]).otherwise(0.0)
    return F.lit(KEYWORD) / (rank + K) + bonus


def vector_part(rank: Column) -> Column:
    return F.lit(VECTOR) / (rank + K)


def floored(near: DataFrame, keyword: DataFrame, floor: float) -> DataFrame:
    """Neighbours above the floor, or in the keyword list; ranked again."""
    kept = near.join(keyword.select("id", F.lit(True).alias("kw")), "id", "left").where((F.col("cos") >= floor) | F.col("kw")).drop("kw")
    return ranked_again(kept, "cos")


def fused(keyword: DataFrame | None, near: DataFrame | None) -> DataFrame:
    """id, raw score and whether the keyword list has it, from (id, rank) lists; one shuffle on the id."""
    parts = []
    if keyword is not None:
        parts.append(keyword.select("id", keyword_part(F.col("rank")).alias("part"), F.lit(True).alias("kw")))
    if near is not None:
        parts.append(near.select("id", vector_part(F.col("rank")).alias("part"), F.lit(False).alias("kw")))
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("part").alias("raw"), F.bool_or("kw").alias("kw"))


def penalised(scores: DataFrame) -> DataFrame:
    """Raw scores of sidechains times ``PENALTY``."""
    return scores.withColumn("raw", F.round(F.when(F.col("is_sidechain"), F.col("raw") * PENALTY).otherwise(F.col("raw")), 12))


def scaled(raw: Column) -> Column:
    return F.least(F.greatest(raw / BEST, F.lit(0.0)), F.lit(1.0))


def all_concepts(ranked: DataFrame, concepts: int) -> DataFrame:
    """Conversations that every concept hits: ``ranked`` (concept, archive_path, id, raw, kw).

    The best exchange of each concept and conversation counts (ties: the larger id); the score is their mean,
    and the exchange shown is the best of them.
    """
    best = ranked.groupBy("archive_path", "concept").agg(F.max(F.struct("raw", "id")).alias("b"), F.max_by("kw", F.struct("raw", "id")).alias("kw"))
    out = best.groupBy("archive_path").agg(F.count("*").alias("k"), F.avg("b.raw").alias("raw"), F.max("b").alias("shown"), F.bool_or("kw").alias("kw"))
    return out.where(F.col("k") == concepts).select("archive_path", F.col("shown.id").alias("id"), F.round("raw", 12).alias("raw"), "kw")
