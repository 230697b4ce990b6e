"""Conversations rebuilt from message rows.

Messages are ordered by (session, instant, archive, line) in a global range sort, so that a session that
holds a third of all rows is spread over many tasks.  Each task runs a finite-state automaton along its
sorted rows and writes, besides the rows with their local position, one summary per session it met: the
number of messages, the first and last role, and whether all transitions inside were allowed.  Summaries
compose, so the verdict on a session, and the offset of each of its parts, come from a window over its few
summaries.

Automaton: start -user-> asked -assistant-> answered -assistant-> answered -user-> asked; it accepts in
``answered``.  A missing role or an unreadable timestamp has no transition.

Defined results: empty tables give no rows; rows without session, text or readable JSON are no messages;
rows delivered twice count once; equal instants are ordered by archive and line; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidlog.session import cut, shuffle_width

#: A date and time with zone, as in RFC 3339 and its common relatives.
INSTANT = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}([.,]\d+)?\s?([Zz]|[+-]\d{2}(:?\d{2})?)$"
SOLID = r"(?U)[^\s\p{Z}\p{C}]"


def instant(text: Column) -> Column:
    """Microseconds since 1970 of a text with an existing date and time and a zone; else null."""
    t = F.trim(text)
    part = lambda at, n: F.substring(t, at, n).try_cast("int")
    fraction = F.rpad(F.substring(F.regexp_extract(t, r"[.,](\d+)", 1), 1, 6), 6, "0")
    zone = F.regexp_extract(t, r"([Zz]|[+-]\d{2}:?\d{0,2})$", 1)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    hours, minutes = F.substring(digits, 1, 2).try_cast("int"), F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    shift = F.when(F.upper(zone) == "Z", 0).when((hours <= 23) & (minutes <= 59), sign * (hours * 3600 + minutes * 60))
    # in UTC whatever the session's zone; a minute has 60 seconds
    moment = F.try_make_timestamp(part(1, 4), part(6, 2), part(9, 2), part(12, 2), part(15, 2), F.substring(t, 18, 2).try_cast("decimal(8,6)"), F.lit("UTC"))
    base = F.when(part(18, 2) < 60, F.unix_seconds(moment))
    return F.when(t.rlike(INSTANT), (base - shift) * 1_000_000 + F.coalesce(fraction.try_cast("long"), F.lit(0)))


def _string(v: Column, path: str) -> Column:
    x = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(v, path, "string"))


def _says(v: Column, typed: bool) -> Column:
    """Whether some element of an array variant has non-blank text (``typed``: in a text block)."""

    def one(b: Column) -> Column:
        said = _string(b, "$.text").rlike(SOLID)
        return said & (_string(b, "$.type") == "text") if typed else said

    return F.coalesce(F.exists(F.try_variant_get(v, "$", "array<variant>"), one), F.lit(False))


MESSAGE = ["tbl", "session_id", "at", "archive_path", "line", "row_id", "role"]


def claude_messages(rows: DataFrame) -> DataFrame:
    """Messages of provider A, one per (archive_path, line)."""
    sessions = rows.where("sessionId is not null").groupBy("archive_path").agg(F.min("sessionId").alias("other"))
    v = F.try_parse_json("content")
    human = (
        (F.col("role").isNull() | F.col("role").isin("user", "assistant"))
        & ~F.coalesce("isMeta", F.lit(False))
        & ~F.coalesce("isCompactSummary", F.lit(False))
        & F.coalesce(F.col("origin_kind") == "human", F.lit(True))
    )
    said = F.coalesce(_string(F.col("v"), "$").rlike(SOLID), F.lit(False)) | _says(F.col("v"), True)
    msgs = rows.where(human).withColumn("v", v).where(said)
    msgs = msgs.select("sessionId", instant(F.col("timestamp")).alias("at"), "archive_path", "line", "row_id", "role")
    msgs = msgs.groupBy("archive_path", "line").agg(F.min_by(F.struct("sessionId", "at", "row_id", "role"), "row_id").alias("m")).select("archive_path", "line", "m.*")
    known = msgs.where("sessionId is not null").withColumnRenamed("sessionId", "session_id")
    lost = msgs.where("sessionId is null").drop("sessionId").join(sessions, "archive_path").withColumnRenamed("other", "session_id")
    return known.unionByName(lost).withColumn("tbl", F.lit("claude")).select(*MESSAGE)


def modern_messages(rows: DataFrame) -> DataFrame:
    """Messages of provider B, one per (archive_path, line)."""
    v = F.col("v")
    heads = rows.where("type = 'session_meta'").withColumn("v", F.try_parse_json("payload"))
    heads = heads.select("archive_path", "line", "row_id", _string(v, "$.id").alias("session_id")).where("session_id is not null")
    heads = heads.groupBy("archive_path").agg(F.min_by("session_id", F.struct("line", "row_id")).alias("session_id"))
    msgs = rows.where("type = 'response_item'").withColumn("v", F.try_parse_json("payload")).where(_string(v, "$.type") == "message")
    role = F.try_variant_get(v, "$.role", "string")
    content = F.try_variant_get(v, "$.content", "variant")
    msgs = msgs.withColumn("role", role).where("role is null or role in ('user', 'assistant')").where(_says(content, False))
    msgs = msgs.select(instant(F.col("timestamp")).alias("at"), "archive_path", "line", "row_id", "role")
    msgs = msgs.groupBy("archive_path", "line").agg(F.min_by(F.struct("at", "row_id", "role"), "row_id").alias("m")).select("archive_path", "line", "m.*")
    return msgs.join(heads, "archive_path").withColumn("tbl", F.lit("modern")).select(*MESSAGE)


ALLOWED = {(None, "user"): True, ("user", "assistant"): True, ("assistant", "assistant"): True, ("assistant", "user"): True}
PARTS = "tbl string, session_id string, part int, pos bigint, row_id bigint, role string, n bigint, first_role string, last_role string, ok boolean"


def _automaton(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their position in this task's part of the session; after each part its summary (n set)."""
    part = TaskContext.get().partitionId()
    key, n, first, state, ok = None, 0, None, None, True
    names = [x.split()[0] for x in PARTS.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=schema)

    for batch in batches:
        for tbl, session, at, row_id, role in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if (tbl, session) != key:
                if key:
                    out.append((*key, part, None, None, None, n, first, state, ok))
                key, n, first, state, ok = (tbl, session), 0, role, None, True
            ok = ok and role is not None and at is not None and (n == 0 or (state, role) in ALLOWED)
            out.append((tbl, session, part, n, row_id, role, None, None, None, None))
            state = role
            n += 1
        if len(out) >= 10_000:
            yield flush()
            out.clear()
    if key:
        out.append((*key, part, None, None, None, n, first, state, ok))
    if out:
        yield flush()


def kept_conversations(messages: DataFrame) -> DataFrame:
    """tbl, session_id, pos, row_id, role of the messages of all conversations the automaton accepts."""
    spark = messages.sparkSession
    written = cut(messages.where("session_id is not null"))
    order = ["tbl", "session_id", "at", "archive_path", "line", "row_id"]
    ranged = written.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    parts = cut(ranged.select("tbl", "session_id", "at", "row_id", "role").mapInArrow(_automaton, PARTS))
    key = ["tbl", "session_id"]
    w = Window.partitionBy(*key).orderBy("part")
    summary = parts.where("n is not null").select(*key, "part", "n", "first_role", "last_role", "ok")
    joint = summary.withColumns({
        "before": F.lag("last_role").over(w),
        "last": F.lead("part").over(w).isNull(),
        "offset": F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    fine = F.col("ok") & F.when(F.col("before").isNull(), F.col("first_role") == "user").otherwise(~((F.col("before") == "user") & (F.col("first_role") == "user")))
    fine = F.coalesce(fine, F.lit(False)) & (~F.col("last") | (F.col("last_role") == "assistant"))
    kept = joint.withColumn("fine", F.min(F.coalesce(fine, F.lit(False))).over(Window.partitionBy(*key))).where("fine").select(*key, "part", "offset")
    rows = parts.where("n is null").select(*key, "part", "pos", "row_id", "role")
    return rows.join(kept, [*key, "part"]).select(*key, (F.col("pos") + F.col("offset")).alias("pos"), "row_id", "role")
