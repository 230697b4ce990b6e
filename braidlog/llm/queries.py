"""Queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlog.functions.arrow import map_rows, replace_columns, safe
from braidlog.functions.jsontext import loads
from braidlog.llm import conversations, defects, encoding, leaks, neardup, packing, personal, personal_training, splitting
from braidlog.session import cut
from braidlog.sources.tables import table

LIMIT, OVERLAP = 2000, 100


# ---- 1: personal data ---------------------------------------------------------------------------


def _finder(spark: SparkSession) -> Callable[[], personal.Finder]:
    sent = spark.sparkContext.broadcast(personal_training.load())  # a few thousand leaves, from a file
    return lambda: personal.Finder(sent.value)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """One row for each kind of personal data in a field."""
    finder = _finder(spark)
    schema = "tbl string, row_id bigint, field string, kind string"

    def exchanges() -> Callable[..., Iterable[tuple]]:
        f = finder()
        return lambda rid, *texts: [("exchanges", rid, n, k) for n, t in zip(("user_message", "assistant_message"), texts, strict=True) if t for k in sorted({k for *_, k in f.spans(t)})]

    def claude() -> Callable[..., Iterable[tuple]]:
        f = finder()
        return lambda rid, content: [("claude", rid, "content", k) for k in sorted(set(f.redact_json(content)[1]))]

    a = map_rows(table(spark, d, "exchanges").select(F.col("id").cast("long"), "user_message", "assistant_message"), exchanges, schema)
    b = map_rows(table(spark, d, "claude").select(F.col("row_id").cast("long"), "content"), claude, schema)
    return a.unionByName(b)


def p1_exchanges(spark: SparkSession, d: str) -> DataFrame:
    """exchanges with placeholders in both messages; every row and column, in one pass."""
    finder = _finder(spark)

    def make() -> Callable[[object], object]:
        f = finder()
        return lambda text: f.redact(text)[0]

    return replace_columns(table(spark, d, "exchanges"), ["user_message", "assistant_message"], make)


def p1_claude(spark: SparkSession, d: str) -> DataFrame:
    """claude with placeholders in content, which stays valid JSON."""
    finder = _finder(spark)

    def make() -> Callable[[object], object]:
        f = finder()
        return lambda content: f.redact_json(content)[0]

    return replace_columns(table(spark, d, "claude"), ["content"], make)


# ---- 2: near duplicates -------------------------------------------------------------------------


def _exchange_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "exchanges").select(F.col("id").cast("long").alias("id"), neardup.joined("user_message", "assistant_message").alias("text"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of exchanges that share half of their sequences of three words."""
    texts = _exchange_texts(spark, d)
    sig = cut(neardup.signatures(texts))
    return neardup.pairs(neardup.links(texts, sig), neardup.members(sig))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Class, group and number of links of every exchange."""
    texts = _exchange_texts(spark, d)
    sig = cut(neardup.signatures(texts))
    return neardup.groups(neardup.links(texts, sig), neardup.members(sig))


def p2_forks(spark: SparkSession, d: str) -> DataFrame:
    """Forked sessions with a known parent: their exchanges, and those that are near duplicates of the parent's."""
    texts = _exchange_texts(spark, d)
    sig = cut(neardup.signatures(texts))
    heads = table(spark, d, "fork").where("type = 'session_meta'").withColumn("v", F.try_parse_json("payload"))
    heads = heads.select("archive_path", "line", F.try_variant_get("v", "$.id", "string").alias("session_id"), F.try_variant_get("v", "$.forked_from_id", "string").alias("forked_from_id"))
    own = heads.groupBy("archive_path").agg(F.min_by(F.struct("session_id", "forked_from_id"), "line").alias("h")).select("h.*")
    kin = own.where("session_id is not null and forked_from_id is not null").distinct()
    of = table(spark, d, "exchanges").select(F.col("id").cast("long").alias("id"), "session_id")
    return neardup.shared_with(neardup.links(texts, sig), neardup.members(sig), kin, of)


# ---- 3: defective pairs -------------------------------------------------------------------------


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Exchanges whose answer is defective, with the defect."""
    return defects.defective(table(spark, d, "exchanges"))


# ---- 6: conversations ---------------------------------------------------------------------------


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Messages of the kept conversations, in order."""
    msgs = conversations.claude_messages(table(spark, d, "claude")).unionByName(conversations.modern_messages(table(spark, d, "modern")))
    return conversations.kept_conversations(msgs).select("tbl", "session_id", "pos", "row_id")


# ---- 7: splitting -------------------------------------------------------------------------------

PIECES = "tbl string, row_id bigint, field string, item_pos bigint, piece bigint, start bigint, own_start bigint, stop bigint, text string"


def _pieces_of(tbl: str, rid: int, field: str, pos: int, text: str) -> Iterable[tuple]:
    for k, (start, own, stop) in enumerate(splitting.pieces(text, LIMIT, OVERLAP)):
        yield tbl, rid, field, pos, k, start, own, stop, safe(text[start:stop])


def _from_exchanges(spark: SparkSession, d: str, field: str) -> DataFrame:
    rows = table(spark, d, "exchanges").where(F.length(field) > LIMIT).select("id", field)

    def make() -> Callable[..., Iterable[tuple]]:
        return lambda rid, text: _pieces_of("exchanges", rid, field, 0, text)

    return map_rows(rows, make, PIECES, 500)


def _from_claude(spark: SparkSession, d: str) -> DataFrame:
    # a JSON text is never shorter than the texts in it
    rows = table(spark, d, "claude").where(F.length("content") > LIMIT).select("row_id", "content")

    def each(rid: int, content: str) -> Iterable[tuple]:
        try:
            value = loads(content)
        except ValueError:
            return
        if isinstance(value, str):
            texts = [(0, value)]
        elif isinstance(value, list):
            texts = [(i, b["text"]) for i, b in enumerate(value) if isinstance(b, dict) and b.get("type") == "text" and isinstance(b.get("text"), str)]
        else:
            return
        for pos, text in texts:
            if len(text) > LIMIT:
                yield from _pieces_of("claude", rid, "content", pos, text)

    return map_rows(rows, lambda: each, PIECES, 500)


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of all texts longer than the limit."""
    parts = [_from_exchanges(spark, d, "user_message"), _from_exchanges(spark, d, "assistant_message"), _from_claude(spark, d)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts that had to be cut: those with a second piece."""
    return p7_pieces(spark, d).where("piece = 1").select("tbl", "row_id", "field", "item_pos")


# ---- 8: packing ---------------------------------------------------------------------------------


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """Container of every piece of every document; 2,048 tokens each."""
    return packing.packed(table(spark, d, "documents"), 2048)


# ---- 9: leaks -----------------------------------------------------------------------------------


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold at least 10 consecutive words of a test item, with the item."""
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """As p9_found, with the number of windows and the stretch of the document they span."""
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


# ---- 10: wrong encodings ------------------------------------------------------------------------


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with text from a wrong decoding."""
    return encoding.garbled(table(spark, d, "documents")).select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """As p10_found, with the restored text and the chain of encodings that explains it."""
    return encoding.garbled(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_exchanges, p1_claude, p2_found, p2_groups, p2_forks, p3_found, p6_found, p7_found, p7_pieces, p8_packed, p9_found, p9_report, p10_found, p10_restored)}

_SOLID = r"[^\s\p{Z}\p{C}]"
_AT = r"""CASE WHEN regexp_full_match(t, '\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}([.,]\d+)?\s?([Zz]|[+-]\d{2}(:?\d{2})?)')
    AND try_cast(substr(t, 1, 10) AS DATE) IS NOT NULL AND substr(t, 12, 2) < '24' AND substr(t, 15, 2) < '60' AND substr(t, 18, 2) < '60' AND (upper(right(t, 1)) = 'Z' OR (substr(z, 1, 2) < '24' AND substr(z || '00', 3, 2) < '60'))
  THEN epoch_us(try_cast(substr(t, 1, 10) AS DATE)::TIMESTAMP) + (substr(t, 12, 2)::BIGINT * 3600 + substr(t, 15, 2)::BIGINT * 60 + substr(t, 18, 2)::BIGINT) * 1000000 + rpad(substr(regexp_extract(t, '[.,](\d+)', 1), 1, 6), 6, '0')::BIGINT
    - CASE WHEN upper(right(t, 1)) = 'Z' THEN 0 ELSE (CASE WHEN starts_with(zone, '-') THEN -1 ELSE 1 END) * (substr(z, 1, 2)::BIGINT * 3600 + substr(z || '00', 3, 2)::BIGINT * 60) * 1000000 END END"""


def _texts_say(blocks: str, typed: str) -> str:
    return f"len(list_filter(CASE WHEN json_type({blocks}) = 'ARRAY' THEN ({blocks})::JSON[] ELSE [] END, lambda b: {typed} json_type(b, '$.text') = 'VARCHAR' AND regexp_matches(json_extract_string(b, '$.text'), '{_SOLID}'))) > 0"


ORACLE = {
    "p2_found": r"""
WITH w AS (SELECT id, list_transform(regexp_extract_all(coalesce(user_message, '') || ' ' || coalesce(assistant_message, ''), '[\p{L}\p{N}]+'), lambda x: lower(x)) w FROM exchanges),
g AS (SELECT DISTINCT id, hash(w[i], w[i + 1], w[i + 2]) h FROM (SELECT id, w, unnest(range(1, len(w) - 1)) i FROM w)),
n AS (SELECT id, count(*) n FROM g GROUP BY 1),
s AS (SELECT a.id id_a, b.id id_b, count(*) k FROM g a JOIN g b USING (h) WHERE a.id < b.id GROUP BY 1, 2)
SELECT id_a, id_b FROM s JOIN n a ON a.id = id_a JOIN n b ON b.id = id_b WHERE k >= 0.5 * (a.n + b.n - k)
""",
    "p6_found": f"""
WITH o AS (SELECT archive_path, min(sessionId) other FROM claude WHERE sessionId IS NOT NULL GROUP BY 1),
c AS (SELECT *, CASE WHEN json_valid(content) THEN content::JSON END j FROM claude),
m AS (SELECT *, CASE WHEN json_valid(payload) THEN payload::JSON END j FROM modern),
h AS (SELECT archive_path, json_extract_string(j, '$.id') session_id FROM m WHERE type = 'session_meta' AND json_type(j, '$.id') = 'VARCHAR' QUALIFY row_number() OVER (PARTITION BY archive_path ORDER BY line, row_id) = 1),
x AS (
  SELECT 'claude' tbl, coalesce(sessionId, other) session_id, timestamp, archive_path, line, row_id, role FROM c LEFT JOIN o USING (archive_path)
  WHERE (role IS NULL OR role IN ('user', 'assistant')) AND NOT coalesce(isMeta, false) AND NOT coalesce(isCompactSummary, false) AND coalesce(origin_kind, 'human') = 'human'
    AND (CASE WHEN json_type(j) = 'VARCHAR' THEN regexp_matches(json_extract_string(j, '$'), '{_SOLID}') ELSE {_texts_say('j', "json_extract_string(b, '$.type') = 'text' AND ")} END)
  UNION ALL
  SELECT 'modern', session_id, timestamp, archive_path, line, row_id, json_extract_string(j, '$.role') FROM m JOIN h USING (archive_path)
  WHERE type = 'response_item' AND json_extract_string(j, '$.type') = 'message' AND coalesce(json_extract_string(j, '$.role'), 'user') IN ('user', 'assistant') AND {_texts_say("j -> '$.content'", '')}),
d AS (SELECT *, trim(timestamp) t, regexp_extract(trim(timestamp), '([Zz]|[+-]\\d{{2}}:?\\d{{0,2}})$', 1) zone FROM x WHERE session_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tbl, archive_path, line ORDER BY row_id) = 1),
e AS (SELECT *, {_AT} at_us FROM (SELECT *, regexp_replace(zone, '[^0-9]', '', 'g') z FROM d)),
r AS (SELECT *, row_number() OVER w - 1 pos, lead(role) OVER w after, count(*) OVER p n, count(at_us) OVER p timed, count(role) OVER p roled FROM e WINDOW w AS (PARTITION BY tbl, session_id ORDER BY at_us, archive_path, line), p AS (PARTITION BY tbl, session_id)),
k AS (SELECT tbl, session_id FROM r GROUP BY 1, 2 HAVING bool_and(n = timed AND n = roled) AND bool_and(pos > 0 OR role = 'user') AND bool_and(role <> 'user' OR coalesce(after, 'user') = 'assistant'))
SELECT tbl, session_id, pos, row_id FROM r SEMI JOIN k USING (tbl, session_id)
""",
    "p7_found": """
SELECT 'exchanges' tbl, id row_id, 'user_message' field, 0::BIGINT item_pos FROM exchanges WHERE length(user_message) > 2000
UNION ALL SELECT 'exchanges', id, 'assistant_message', 0 FROM exchanges WHERE length(assistant_message) > 2000
UNION ALL
SELECT 'claude', row_id, 'content', 0 FROM claude
WHERE length(content) > 2000 AND CASE WHEN json_valid(content) THEN json_type(content) = 'VARCHAR' AND length(json_extract_string(content, '$')) > 2000 ELSE false END
UNION ALL
SELECT 'claude', row_id, 'content', (i - 1)::BIGINT FROM (
  SELECT row_id, generate_subscripts(a, 1) i, unnest(a) b FROM (
    SELECT row_id, CASE WHEN json_valid(content) AND json_type(content) = 'ARRAY' THEN content::JSON[] END a FROM claude WHERE length(content) > 2000))
WHERE json_extract_string(b, '$.type') = 'text' AND json_type(b, '$.text') = 'VARCHAR' AND length(json_extract_string(b, '$.text')) > 2000
""",
    "p9_found": r"""
WITH iw AS (SELECT item_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) w FROM eval_items),
ig AS (SELECT DISTINCT item_id, array_to_string(w[i:i+9], ' ') g FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) i FROM iw)),
dw AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) w FROM documents),
dg AS (SELECT doc_id, array_to_string(w[i:i+9], ' ') g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) i FROM dw))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
""",
}
