"""Parts of full-text search: query tokens, document frequencies, the BM25 formula, top lists.

The kept index that uses them is in ``operators.index``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidlog.functions.text import analyzer, tokens

K1, B, COMMON_SHARE, DIGITS = 1.2, 0.75, 0.2, 9


@dataclass(frozen=True)
class Token:
    text: str
    prefix: bool = False


def query_tokens(query: str) -> list[Token]:
    """Distinct tokens of a query in order; a single Hangul syllable stands for its prefix."""
    return [Token(w, prefix=len(w) == 1 and "가" <= w <= "힣") for w in dict.fromkeys(analyzer(False)(query))]


def weight(n: Column | int, total: Column | int) -> Column:
    """Inverse document frequency, never below a millionth."""
    n, total = (x if isinstance(x, Column) else F.lit(float(x)) for x in (n, total))
    return F.greatest(F.log((total - n + 0.5) / (n + 0.5)), F.lit(1e-6))


def term_score(idf: Column, tf: Column, dl: Column, avgdl: Column | float) -> Column:
    avgdl = avgdl if isinstance(avgdl, Column) else F.lit(float(avgdl))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def top(scored: DataFrame, n: int, score: str = "score", key: str = "id") -> DataFrame:
    """The best ``n`` rows, ties by the smaller key, with their rank."""
    best = scored.orderBy(F.desc(score), F.asc(key)).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), F.asc(key))))  # n rows


def frequencies(texts: DataFrame, words: Callable[[Column], Column] = tokens, key: str = "id", text: str = "text") -> DataFrame:
    """Number of texts per term; repeats within a text are dropped where it is read, so one shuffle carries partial sums."""
    return texts.select(F.explode(F.array_distinct(words(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def common(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Terms that more than ``COMMON_SHARE`` of all texts have."""
    total = texts.count()
    return frequencies(texts, key=key, text=text).where(F.col("df") > COMMON_SHARE * total)


def beginning_with(texts: DataFrame, prefix: str, key: str = "id", text: str = "text") -> DataFrame:
    """id, tf, terms of the texts that have tokens with a prefix: how many, and how many different ones."""
    words = texts.select(F.col(key).alias("id"), F.filter(tokens(F.col(text)), lambda w: w.startswith(prefix)).alias("ws"))
    return words.where(F.size("ws") > 0).select("id", F.size("ws").cast("long").alias("tf"), F.size(F.array_distinct("ws")).cast("long").alias("terms"))
