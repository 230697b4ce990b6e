"""Test tables as the engine's inputs, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidlog.operators.index import TextIndex
from braidlog.operators.providers import NOT_TYPED_A
from braidlog.session import shared_path
from braidlog.sources.tables import table


def once(rows: DataFrame) -> DataFrame:
    """Lines delivered twice count once, with the smallest row_id."""
    rest = [c for c in rows.columns if c not in ("archive_path", "line")]
    return rows.groupBy("archive_path", "line").agg(F.min_by(F.struct(*rest), "row_id").alias("r")).select("archive_path", "line", "r.*")


def raw_a(spark: SparkSession, d: str) -> DataFrame:
    """archive_path, line, raw of provider A, the envelope rebuilt around ``content``."""
    df = once(table(spark, d, "claude").drop("ingested_at"))
    head = F.to_json(F.struct("line", "type", "timestamp", "sessionId", "cwd", "isSidechain", "isMeta", "isCompactSummary", F.when(F.col("origin_kind").isNotNull(), F.struct(F.col("origin_kind").alias("kind"))).alias("origin")))
    raw = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"message":{"content":'), F.col("content"), F.lit("}}"))
    return df.select("archive_path", "line", raw.alias("raw"))


def raw_b(spark: SparkSession, d: str, *names: str) -> DataFrame:
    """archive_path, line, raw of provider B."""
    out = None
    for n in names or ("modern", "legacy"):
        df = once(table(spark, d, n).drop("ingested_at"))
        head = F.to_json(F.struct("line", "timestamp", "type"))
        raw = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"payload":'), F.col("payload"), F.lit("}"))
        part = df.select("archive_path", "line", raw.alias("raw"))
        out = part if out is None else out.unionByName(part)
    return out


def docs(spark: SparkSession, d: str) -> DataFrame:
    """documents as a corpus of one exchange each."""
    t = table(spark, d, "documents")
    return t.select(
        F.col("doc_id").alias("id"), F.col("source").alias("archive_path"), F.col("source").alias("session_id"), F.coalesce("project", F.lit("")).alias("project"), F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False)).alias("is_sidechain"),
        F.unix_millis(F.col("created_at").cast("timestamp")).alias("ts"), F.col("text").alias("user_message"), F.lit("").alias("assistant_message"), F.lit(1).cast("long").alias("line_start"), F.lit(1).cast("long").alias("line_end"), "text",
    )


_INDEXES: dict[tuple[str, str, bool], str] = {}


def text_index(spark: SparkSession, d: str, stem: bool = False) -> TextIndex:
    """The kept index of ``docs``, built at its first use in an application."""
    key = (spark.sparkContext.applicationId, d, stem)
    if key not in _INDEXES:
        path = shared_path(spark, "index")
        TextIndex.write(docs(spark, d).select("id", "text", "project", "ts"), path, stem)
        _INDEXES[key] = path
    return TextIndex.open(spark, _INDEXES[key], stem)


def vecs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.concat(F.lit("label_"), F.col("label").cast("string")).alias("project"))


def vector_of(spark: SparkSession, d: str, vec_id: int) -> list[float]:
    """The query vector that the tables hold under an id."""
    return list(table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


def ranked_by(column: str, *ties: str) -> Column:
    return F.row_number().over(Window.orderBy(F.desc(column), *ties))


# ---- SQL ------------------------------------------------------------------------------------------

DOCS = "docs AS (SELECT doc_id id, source archive_path, coalesce(project, '') project, coalesce(doc_id % 5 = 0, false) is_sidechain, epoch_us(created_at) // 1000 ts, text FROM documents)"
VECS = "vecs AS (SELECT vec_id id, embedding::DOUBLE[] e, 'label_' || label project FROM embeddings)"
HANGUL = "[가-힣]"


def sql_hangul(text: str) -> str:
    """SQL for a text with its Hangul runs as pairs."""
    parts = f"regexp_extract_all({text}, '({HANGUL}{{2,}}|{HANGUL}|[^가-힣]+)')"
    pairs = f"list_transform({parts}, lambda p: CASE WHEN regexp_full_match(p, '{HANGUL}{{2,}}') THEN ' ' || array_to_string(list_transform(range(1, length(p)), lambda i: substr(p, i::INT, 2)), ' ') || ' ' ELSE p END)"
    return f"array_to_string({pairs}, '')"


def sql_terms(text: str) -> str:
    """SQL for the tokens of a text, Hangul runs as pairs."""
    whole = f"CASE WHEN regexp_matches({text}, '{HANGUL}{{2}}') THEN {sql_hangul(text)} ELSE {text} END"
    return f"list_filter(string_split_regex(lower({whole}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def sql_bm25(query: list[str], where: str = "true", n: int = 50) -> str:
    """CTEs w, c, kept, bm (id, score, rank) of a query over docs."""
    values = ", ".join(f"({i}, '{t}')" for i, t in enumerate(query))
    return f"""
q(i, t) AS (VALUES {values}),
w AS (SELECT id, archive_path, project, is_sidechain, ts, {sql_terms('text')} ws FROM docs),
c AS (SELECT count(*)::DOUBLE total, avg(coalesce(len(ws), 0)) avgdl FROM w),
tf AS (SELECT w.id, w.project, w.ts, len(ws) dl, q.i, len(list_filter(ws, lambda x: x = q.t)) f FROM w, q),
df AS (SELECT i, count(*) FILTER (f > 0) n FROM tf GROUP BY i),
fit AS (SELECT i, n FROM df, c WHERE n <= 0.2 * total),
kept AS (SELECT * FROM fit UNION ALL SELECT * FROM (SELECT i, n FROM df WHERE i NOT IN (SELECT i FROM fit) AND NOT EXISTS (SELECT 1 FROM fit WHERE n > 0) ORDER BY n, i LIMIT 1)),
sc AS (
  SELECT id, round(sum(greatest(ln((total - n + 0.5) / (n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) score
  FROM tf JOIN kept USING (i), c WHERE {where} GROUP BY id HAVING max(f) > 0),
bm AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) rank FROM (SELECT * FROM sc ORDER BY score DESC, id LIMIT {n}))"""


def sql_knn(where: str = "true", n: int = 50, vec_id: int = 0) -> str:
    """CTEs kn (id, cos, rank) of the nearest vectors."""
    return f"""
d2 AS (SELECT v.id, round(power(list_distance(v.e, x.e), 2), 7) d FROM vecs v, (SELECT e FROM vecs WHERE id = {vec_id}) x WHERE {where}),
kn AS (SELECT id, round(1 - d / 2, 8) cos, row_number() OVER (ORDER BY d, id) rank FROM (SELECT * FROM d2 ORDER BY d, id LIMIT {n}))"""


def sql_joined(parts: str) -> str:
    """SQL for parts joined by a blank line, which is put only behind something."""
    return f"list_reduce(list_prepend('', coalesce({parts}, [])), lambda a, x: CASE WHEN a = '' THEN x ELSE a || chr(10) || chr(10) || x END)"


STARTS = " OR ".join(f"starts_with(regexp_replace(said, '^\\s+', ''), '{p}')" for p in NOT_TYPED_A)
#: CTEs la (lines), fa (facts), sa (segments), ea (exchanges) of provider A over the table of its lines.
FOLD_A = f"""
la AS (SELECT * FROM claude QUALIFY row_number() OVER (PARTITION BY archive_path, line ORDER BY row_id) = 1),
ja AS (SELECT *, CASE WHEN json_valid(content) THEN content::JSON END j FROM la),
ka AS (
  SELECT *, CASE WHEN json_type(j) = 'ARRAY' THEN j::JSON[] ELSE [] END bs FROM ja),
ta AS (
  SELECT *, list_filter(bs, lambda b: json_extract_string(b, '$.type') = 'text' AND json_type(b, '$.text') = 'VARCHAR') texts FROM ka),
ua AS (
  SELECT *, CASE WHEN json_type(j) = 'VARCHAR' THEN json_extract_string(j, '$') WHEN len(texts) > 0 THEN array_to_string(list_transform(texts, lambda b: json_extract_string(b, '$.text')), chr(10)) END said FROM ta),
fa AS (
  SELECT archive_path, line, row_id, j IS NULL is_bad, type, timestamp,
    CASE WHEN j IS NOT NULL AND type = 'user' AND NOT coalesce(isMeta, false) AND NOT coalesce(isCompactSummary, false) AND coalesce(origin_kind, 'human') = 'human' AND NOT coalesce({STARTS}, false) THEN said END start_text,
    CASE WHEN type = 'assistant' THEN list_filter(list_transform(bs, lambda b: CASE
      WHEN json_extract_string(b, '$.type') = 'text' AND json_type(b, '$.text') = 'VARCHAR' THEN json_extract_string(b, '$.text')
      WHEN json_extract_string(b, '$.type') = 'tool_use' AND json_extract_string(b, '$.name') = 'SubagentHandback' AND json_type(b, '$.input.message') = 'VARCHAR' THEN json_extract_string(b, '$.input.message') END), lambda x: x IS NOT NULL) ELSE [] END answers,
    CASE WHEN type = 'assistant' THEN list_filter(list_transform(bs, lambda b: CASE WHEN json_extract_string(b, '$.type') = 'tool_use' AND json_type(b, '$.name') = 'VARCHAR' THEN json_extract_string(b, '$.name') END), lambda x: x IS NOT NULL) ELSE [] END tools
  FROM ua),
sa AS (SELECT *, sum(CASE WHEN start_text IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY archive_path ORDER BY line ROWS UNBOUNDED PRECEDING) segment FROM fa),
ga AS (
  SELECT archive_path, segment::BIGINT segment, min(line) line_start, max(line) line_end, max(start_text) user_message, count(*) FILTER (is_bad) bad_lines, arg_min(timestamp, line) stamp,
    flatten(list(answers ORDER BY line)) answers, flatten(list(tools ORDER BY line)) all_tools
  FROM sa WHERE segment > 0 GROUP BY ALL),
ea AS (
  SELECT archive_path, segment, line_start, line_end, user_message, bad_lines, stamp, {sql_joined('answers')} assistant_message,
    array_to_string(list_filter(all_tools, lambda x, i: list_position(all_tools, x) = i), ',') tools FROM ga)
"""
