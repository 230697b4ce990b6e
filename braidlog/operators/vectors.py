"""Exact nearest neighbours by L2, and a deterministic embedder for tests.

Filters go below the ranking, so they reach the Parquet scan; distances are matrix operations on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidlog.operators.fulltext import top

FLOOR = 0.85


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of a list column as one matrix; vectors of another size are refused."""
    if column.null_count or pc.any(pc.not_equal(pc.list_value_length(column), dim)).as_py():
        raise ValueError(f"a vector is missing or hasn't {dim} numbers")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _least(ids: np.ndarray, d2: np.ndarray, n: int) -> np.ndarray:
    """Positions of the ``n`` least distances, ties by the smaller id."""
    return np.lexsort((ids, d2))[:n]


def nearest(vectors: DataFrame, query: Sequence[float], n: int, key: str = "id") -> DataFrame:
    """The ``n`` nearest rows with ``cos`` (1 - d²/2, for unit vectors) and rank; ties by the smaller key.

    Distances are taken a batch at a time, exactly over all rows; a task keeps its best ``n``.  Filters on ``vectors`` go
    below, to the scan.  A vector of another size than the query's is an error.
    """
    q = np.array(query, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, best = np.empty(0, np.int64), np.empty(0)
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1), len(q))
                ids = np.concatenate((ids, b.column(0).to_numpy()))
                best = np.concatenate((best, np.round(((x - q) ** 2).sum(axis=1), 7)))
                keep = _least(ids, best, n)
                ids, best = ids[keep], best[keep]
        yield pa.record_batch([pa.array(ids), pa.array(-best)], names=[key, "near"])

    near = vectors.select(F.col(key).cast("long"), "embedding").mapInArrow(run, f"{key} bigint, near double")
    return top(near, n, "near", key).withColumn("cos", F.round(1 + F.col("near") / 2, 8)).drop("near")


def nearest_of_many(vectors: DataFrame, queries: DataFrame, n: int, at_once: int = 4096) -> DataFrame:
    """query_id, id, cos, rank of the ``n`` nearest rows of each query (query_id, embedding), exactly over all rows.

    Queries go in blocks of about ``at_once``, each broadcast as one matrix and multiplied with every batch of one pass over
    the vectors; a task sends its best ``n`` of each query.
    """
    spark = vectors.sparkSession
    groups = max(1, -(-queries.count() // at_once))
    out = None
    for g in range(groups):
        mine = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g).select(F.col("query_id").cast("long"), "embedding").collect()  # about ``at_once``
        if not mine:
            continue
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in mine], np.int64), np.array([r[1] for r in mine], np.float64)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            norms = (q**2).sum(axis=1)
            ids = np.empty((len(q), 0), np.int64)
            best = np.empty((len(q), 0))
            for b in batches:
                if b.num_rows:
                    x = _matrix(b.column(1), q.shape[1])
                    d2 = np.round(np.maximum(norms[:, None] + (x**2).sum(axis=1)[None, :] - 2 * (q @ x.T), 0), 7)
                    ids = np.concatenate((ids, np.broadcast_to(b.column(0).to_numpy(), d2.shape)), axis=1)
                    best = np.concatenate((best, d2), axis=1)
                    keep = np.lexsort((ids, best), axis=1)[:, :n]
                    ids, best = np.take_along_axis(ids, keep, 1), np.take_along_axis(best, keep, 1)
            k = ids.shape[1]
            yield pa.record_batch([pa.array(np.repeat(names, k)), pa.array(ids.reshape(-1)), pa.array(best.reshape(-1))], names=["query_id", "id", "d2"])

        part = vectors.select(F.col("id").cast("long"), "embedding").mapInArrow(run, "query_id bigint, id bigint, d2 double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "query_id bigint, id bigint, d2 double")
    w = Window.partitionBy("query_id").orderBy("d2", "id")
    ranked = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return ranked.select("query_id", "id", F.round(1 - F.col("d2") / 2, 8).alias("cos"), "rank")


def _fnv(word: str) -> int:
    h = 0xCBF29CE484222325
    for b in word.encode():
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def hashed(text: str, dim: int = 384) -> list[float]:
    """Counts of tokens by FNV-1a hash, scaled to length 1; zeros for a text without tokens."""
    v = np.zeros(dim, np.float32)
    word = []
    for c in [*text.lower(), " "]:
        if c.isalnum():
            word.append(c)
        elif word:
            v[_fnv("".join(word)) % dim] += 1
            word = []
    n = float(np.sqrt((v.astype(np.float64) ** 2).sum()))
    return (v / n if n else v).tolist()


class Embedder(Protocol):
    """What turns texts into vectors: made once a worker from ``make``, then called on lists of texts."""

    dim: int

    def make(self) -> Callable[[list[str]], Sequence[Sequence[float]]]: ...


@dataclass(frozen=True)
class Hashed:
    """The deterministic embedder of tests and benches."""

    dim: int = 384

    def make(self) -> Callable[[list[str]], Sequence[Sequence[float]]]:
        return lambda texts: [hashed(t, self.dim) for t in texts]


def embed(embedder: Embedder | int = 384):
    """Arrow UDF of an embedder (a number: the hashed one of that size); wrong counts or sizes of vectors are refused."""
    maker = Hashed(embedder) if isinstance(embedder, int) else embedder

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = maker.make()
        for t in texts:
            some = [x for x in t if x is not None]
            made = [[float(x) for x in v] for v in model(some)] if some else []
            if len(made) != len(some) or any(len(v) != maker.dim for v in made):
                raise ValueError(f"the embedder gave {len(made)} vectors for {len(some)} texts, or some without {maker.dim} numbers")
            rest = iter(made)
            yield pd.Series([None if x is None else next(rest) for x in t])

    return run


def pending(exchanges: DataFrame, vectors: DataFrame) -> DataFrame:
    """Exchanges without a vector."""
    return exchanges.join(vectors.select("id"), "id", "left_anti")


def attach(vectors: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Vectors with the facts of their exchange as it is now; those of deleted ones go."""
    return vectors.join(exchanges.select("id", "project", "ts", "is_sidechain"), "id")
