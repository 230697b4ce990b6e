"""A kept inverted index: postings sorted by term, so that a search reads the row groups of its terms only.

``postings``  (term, id, tf, dl, project, ts): one row per term of a text, in ranges of (term, id); the filters' columns are
              stored beside, so filters reach the scan and no texts are read;
``terms``     (term, df), sorted by term, for the planner;
``corpus``    one row: number of texts and their mean length, filters or not.

Building is one pass over the texts and one shuffle: a text's terms are counted where it is read.  A hot term is cut by id
into as many ranges as it fills.  With ``stem`` the analyzer folds marks and stems (Porter); without, tokens stay as they are.

Defined results: null and empty texts have no terms but count as texts; ties go to the smaller id; a query without
tokens, and an empty index, give no rows; other columns of the texts are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidlog.functions.text import analyzer
from braidlog.operators.fulltext import COMMON_SHARE, DIGITS, Token, query_tokens, term_score, top, weight
from braidlog.session import shuffle_width

POSTINGS = "term string, id bigint, tf int, dl int, project string, ts bigint"
_ARROW = pa.schema([("term", pa.string()), ("id", pa.int64()), ("tf", pa.int32()), ("dl", pa.int32()), ("project", pa.string()), ("ts", pa.int64())])


def postings_of(texts: DataFrame, stem: bool) -> DataFrame:
    """Postings of (id, text, project, ts); the row of term '' stands for the text itself."""
    most = 50_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = analyzer(stem)
        out: list[list] = [[] for _ in _ARROW]

        def flush() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(c, f.type) for c, f in zip(out, _ARROW, strict=True)], schema=_ARROW)
            for c in out:
                c.clear()
            return batch

        for b in batches:
            for rid, text, project, ts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = terms(text) if text else []
                count = Counter(words)
                n = len(count) + 1
                for c, values in zip(out, (["", *count], [rid] * n, [0, *count.values()], [len(words)] * n, [project] * n, [ts] * n), strict=True):
                    c.extend(values)
                if len(out[0]) >= most:
                    yield flush()
        if out[0]:
            yield flush()

    return texts.select(F.col("id").cast("long"), "text", "project", F.col("ts").cast("long")).mapInArrow(run, POSTINGS)


@dataclass(frozen=True)
class Plan:
    """What the planner keeps of a query: its tokens as terms, their frequencies, and which of them count."""

    terms: list[Token]
    df: list[int]
    kept: list[int]


@dataclass(frozen=True)
class TextIndex:
    postings: DataFrame
    terms: DataFrame
    total: int
    avgdl: float
    stem: bool = True

    @classmethod
    def write(cls, texts: DataFrame, path: str, stem: bool = True) -> TextIndex:
        """Build the index of (id, text, project, ts) below ``path`` and open it."""
        spark = texts.sparkSession
        order = ["term", "id"]
        rows = postings_of(texts, stem).repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
        rows.write.mode("overwrite").option("parquet.block.size", 16 << 20).parquet(f"{path}/postings")
        kept = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
        df = kept.where("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
        df.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        kept.where("term = ''").agg(F.count("*").alias("total"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl")).coalesce(1).write.mode("overwrite").parquet(f"{path}/corpus")
        return cls.open(spark, path, stem)

    @classmethod
    def open(cls, spark: SparkSession, path: str, stem: bool = True) -> TextIndex:
        total, avgdl = spark.read.schema("total bigint, avgdl double").parquet(f"{path}/corpus").first()
        return cls(spark.read.schema(POSTINGS).parquet(f"{path}/postings").where("term <> ''"), spark.read.schema("term string, df bigint").parquet(f"{path}/terms"), total, avgdl, stem)

    @classmethod
    def of(cls, texts: DataFrame, stem: bool = True) -> TextIndex:
        """An index that isn't kept: each search reads the texts again.  For small or changing tables."""
        rows = postings_of(texts, stem)
        total, avgdl = rows.where("term = ''").agg(F.count("*"), F.coalesce(F.avg("dl"), F.lit(0.0))).first()
        rows = rows.where("term <> ''")
        return cls(rows, rows.groupBy("term").agg(F.count("*").alias("df")), total, avgdl, stem)

    # ---- one query

    def plan(self, query: str) -> Plan:
        """Drop tokens that more than a fifth of all texts have; if nothing kept matches, restore the rarest."""
        terms = analyzer(self.stem)
        tokens = query_tokens(query)
        found = [t if t.prefix else Token((terms(t.text) or [t.text])[0]) for t in tokens]
        plain = sorted({t.text for t in found if not t.prefix})
        known = {r[0]: r[1] for r in self.terms.where(F.col("term").isin(plain)).collect()} if plain else {}  # the query's terms
        df = [self.postings.where(F.col("term").startswith(t.text)).select("id").distinct().count() if t.prefix else known.get(t.text, 0) for t in found]
        kept = [i for i, t in enumerate(found) if t.prefix or self.total == 0 or df[i] <= COMMON_SHARE * self.total]
        dropped = [i for i in range(len(found)) if i not in kept]
        if dropped and not any(found[i].prefix or df[i] > 0 for i in kept):
            kept.append(min(dropped, key=lambda i: (df[i], i)))
        return Plan(found, df, sorted(kept))

    def scored(self, p: Plan, keep: Column | None = None) -> DataFrame:
        """id and score of all texts with a kept token that the filter lets through."""
        rows = self.postings if keep is None else self.postings.where(keep)
        times = Counter(p.terms[i].text for i in p.kept if not p.terms[i].prefix and p.df[i])
        freq = {p.terms[i].text: p.df[i] for i in p.kept}
        parts = None
        if times:
            idf = F.lit(0.0)
            for t, k in times.items():
                idf = F.when(F.col("term") == t, weight(freq[t], self.total) * F.lit(float(k))).otherwise(idf)
            hits = rows.where(F.col("term").isin(sorted(times)))
            parts = hits.select("id", term_score(idf, F.col("tf").cast("double"), F.col("dl"), self.avgdl).alias("part"))
        for i in p.kept:
            if p.terms[i].prefix:
                union = rows.where(F.col("term").startswith(p.terms[i].text)).groupBy("id").agg(F.sum("tf").cast("double").alias("tf"), F.max("dl").alias("dl"))
                more = union.select("id", term_score(weight(p.df[i], self.total), F.col("tf"), F.col("dl"), self.avgdl).alias("part"))
                parts = more if parts is None else parts.unionByName(more)
        if parts is None:
            return rows.where(F.lit(False)).select("id", F.lit(0.0).alias("score"))
        return parts.groupBy("id").agg(F.round(F.sum("part"), DIGITS).alias("score"))

    def best(self, query: str, n: int, keep: Column | None = None) -> DataFrame:
        """id, score, rank of the best ``n`` texts."""
        return top(self.scored(self.plan(query), keep), n)

    # ---- many queries

    def best_of_many(self, queries: DataFrame, n: int, batch_key: str = "query_id") -> DataFrame:
        """``query_id``, id, score, rank of the best ``n`` texts of each query (query_id, query), all in one job.

        Tokens are dropped, restored and widened to prefixes per query, exactly as for a single one.
        """
        stem = self.stem

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms = analyzer(stem)
            plain = analyzer(False)
            for b in batches:
                out = []
                for qid, query in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    for pos, w in enumerate(dict.fromkeys(plain(query or ""))):
                        lone = len(w) == 1 and "가" <= w <= "힣"
                        out.append((qid, pos, w if lone else (terms(w) or [w])[0], lone))
                yield pa.record_batch([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.string(), pa.bool_()))], names=[batch_key, "pos", "token", "prefix"])

        asked = queries.select(F.col(batch_key).cast("long"), "query").mapInArrow(run, f"{batch_key} bigint, pos int, token string, prefix boolean")
        with_df = asked.where("not prefix").join(self.terms.withColumnRenamed("term", "token"), "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
        fit = F.lit(self.total == 0) | (F.col("df") <= COMMON_SHARE * self.total)
        w = Window.partitionBy(batch_key)
        prefixes = asked.where("prefix")
        has_prefix = prefixes.select(batch_key, F.lit(True).alias("any_prefix")).distinct()
        judged = with_df.withColumn("fit", fit).join(has_prefix, batch_key, "left").withColumns({
            "matches": F.max(F.col("fit") & (F.col("df") > 0)).over(w) | F.coalesce("any_prefix", F.lit(False)),
            "rarest": F.row_number().over(w.orderBy("fit", "df", "pos")),
        })
        kept = judged.where(F.col("fit") | (~F.col("matches") & (F.col("rarest") == 1))).where("df > 0").select(batch_key, "pos", "token", "df")
        plain_hits = kept.join(self.postings.withColumnRenamed("term", "token"), "token").select(batch_key, "pos", "id", "tf", "dl", "df")
        starts = self.postings.where(F.substring("term", 1, 1).rlike("[가-힣]")).withColumn("token", F.substring("term", 1, 1))
        union = prefixes.select(batch_key, "pos", "token").join(starts, "token").groupBy(batch_key, "pos", "id").agg(F.sum("tf").alias("tf"), F.max("dl").alias("dl"))
        union = union.join(union.groupBy(batch_key, "pos").agg(F.count("*").alias("df")), [batch_key, "pos"])
        hits = plain_hits.unionByName(union.select(batch_key, "pos", "id", F.col("tf").cast("int"), "dl", "df"))
        part = term_score(weight(F.col("df").cast("double"), F.lit(float(self.total))), F.col("tf").cast("double"), F.col("dl"), self.avgdl)
        scored = hits.select(batch_key, "id", part.alias("part")).groupBy(batch_key, "id").agg(F.round(F.sum("part"), DIGITS).alias("score"))
        ranks = Window.partitionBy(batch_key).orderBy(F.desc("score"), F.asc("id"))
        return scored.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= n)
