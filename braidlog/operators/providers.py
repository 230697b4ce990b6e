"""Line facts: what the lines of each producer's transcripts say, as expressions over VARIANT.

Both producers give the same columns, so that everything behind is one plan:
``archive_path, line, is_bad, start_text, answer_part, fallback_part, tool_parts, items, ts`` and the file's
``session_id, cwd, is_sidechain, skipped`` joined from one aggregation per file.

A line's raw text is parsed once; blank lines have been left out by the source but keep their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidlog.functions.text import cut_bytes, left_trimmed, starts_with_any
from braidlog.functions.timefn import millis

# Texts that begin like this were not typed by the user.
NOT_TYPED_A = ["[Request interrupted by user", "<local-command-", "<bash-stdout>", "<bash-stderr>", "<teammate-message", "Another Claude session sent a message:"]
NOT_TYPED_B = ["# AGENTS.md instructions", "<environment_context>", "<codex_internal_context>", "<user_instructions>", "<recommended_plugins>", "<skill>"]
#: The tool whose input is the final answer of a subagent, and the name of shell calls, which have none.
HANDBACK, SHELL = "SubagentHandback", "local_shell"
TEXT_BYTES, TOOL_BYTES = 16_384, 4_096
#: The path part that marks a subagent's file.
SUBAGENTS = "subagents"


def parsed(lines: DataFrame) -> DataFrame:
    """``archive_path, line, raw`` -> the same with ``v`` (null for bad lines)."""
    return lines.select("archive_path", "line", F.try_parse_json("raw").alias("v"))


def text_at(v: Column, path: str) -> Column:
    """The string at a path; null for anything else."""
    x = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(v, path, "string"))


def flag_at(v: Column, path: str) -> Column:
    x = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(x) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def display(v: Column, path: str) -> Column:
    """A value as text: strings as they are, null empty, anything else as JSON."""
    x = F.try_variant_get(v, path, "variant")
    s = F.schema_of_variant(x)
    return F.when(s == "STRING", F.try_variant_get(v, path, "string")).when(x.isNull() | (s == "VOID"), "").otherwise(F.to_json(x))


def blocks(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def block_texts(bs: Column, kind: str, glue: str) -> Column:
    """Texts of the blocks of a kind, joined; null where there is none."""
    texts = F.filter(F.transform(F.filter(bs, lambda b: text_at(b, "$.type") == kind), lambda b: text_at(b, "$.text")), lambda t: t.isNotNull())
    return F.when(F.size(texts) > 0, F.array_join(texts, glue))


def _is(v: Column, path: str, value: str) -> Column:
    return F.coalesce(text_at(v, path) == value, F.lit(False))


def item_text(role: str, text: Column) -> Column:
    return F.concat(F.lit(f"**{role}:** "), cut_bytes(text, TEXT_BYTES))


def item_tool(name: Column, given: Column) -> Column:
    return F.concat(F.lit("**Tool "), F.coalesce(name, F.lit("?")), F.lit(":** "), cut_bytes(given, TOOL_BYTES))


def item_result(text: Column) -> Column:
    return F.concat(F.lit("**Result:** "), cut_bytes(text, TOOL_BYTES))


def _strings(*values: Column) -> Column:
    """Array of the values that aren't null."""
    return F.filter(F.array(*values), lambda x: x.isNotNull()) if values else F.array().cast("array<string>")


def _said_of_file(v: Column) -> list[Column]:
    """What a line of provider A says of its file."""
    return [
        text_at(v, "$.sessionId").alias("line_session"),
        text_at(v, "$.cwd").alias("line_cwd"),
        flag_at(v, "$.isSidechain").alias("line_sidechain"),
        F.array_contains(F.split("archive_path", "/"), SUBAGENTS).alias("path_sidechain"),
    ]


def facts_a(lines: DataFrame, items: bool = True) -> DataFrame:
    """Line facts of provider A from parsed lines; without rendered ``items`` the plan is a good deal smaller.

    Each block is read once into a struct, in a projection of its own; what follows works on plain strings.
    """
    v, content = F.col("v"), "$.message.content"
    kind, whole, bs = F.col("kind"), F.col("whole"), F.col("bs")

    def read(b: Column) -> Column:
        return F.struct(text_at(b, "$.type").alias("t"), text_at(b, "$.text").alias("x"), text_at(b, "$.name").alias("n"))

    first = lines.select("archive_path", "line", "v", text_at(v, "$.type").alias("kind"), text_at(v, content).alias("whole"), F.transform(blocks(v, content), read).alias("bs"))
    none = F.array().cast("array<string>")
    user, assistant = F.coalesce(kind == "user", F.lit(False)), F.coalesce(kind == "assistant", F.lit(False))
    some = lambda xs: F.filter(xs, lambda x: x.isNotNull())
    texts = some(F.transform(bs, lambda b: F.when(b["t"] == "text", b["x"])))
    said = F.coalesce(whole, F.when(F.size(texts) > 0, F.array_join(texts, "\n")))
    typed = ~F.coalesce(flag_at(v, "$.isMeta"), F.lit(False)) & ~F.coalesce(flag_at(v, "$.isCompactSummary"), F.lit(False)) & F.coalesce(text_at(v, "$.origin.kind") == "human", F.lit(True))
    start = F.when(user, F.when(typed, said))
    start = F.when(~starts_with_any(left_trimmed(start), NOT_TYPED_A), start)
    back = lambda i: text_at(F.get(blocks(v, content), i), "$.input.message")
    parts = some(F.transform(bs, lambda b, i: F.when(b["t"] == "text", b["x"]).when((b["t"] == "tool_use") & (b["n"] == HANDBACK), back(i))))
    tools = some(F.transform(bs, lambda b: F.when(b["t"] == "tool_use", b["n"])))

    def result(b: Column) -> Column:
        inner = some(F.transform(blocks(b, "$.content"), lambda x: text_at(x, "$.text")))
        array = F.schema_of_variant(F.try_variant_get(b, "$.content", "variant")).startswith("ARRAY")
        return F.when(F.coalesce(array, F.lit(False)), F.array_join(inner, "\n")).otherwise(display(b, "$.content"))

    def rendered(role: str) -> Column:
        each = F.transform(
            blocks(v, content),
            lambda b: F.when((text_at(b, "$.type") == "text") & (text_at(b, "$.text") != ""), item_text(role, text_at(b, "$.text")))
            .when(text_at(b, "$.type") == "tool_use", item_tool(text_at(b, "$.name"), F.coalesce(F.to_json(F.try_variant_get(b, "$.input", "variant")), F.lit("null"))))
            .when(text_at(b, "$.type") == "tool_result", item_result(result(b))),
        )
        return F.when(whole != "", F.array(item_text(role, whole))).otherwise(some(each))

    return first.select(
        "archive_path",
        "line",
        v.isNull().alias("is_bad"),
        start.alias("start_text"),
        F.when(assistant, parts).otherwise(none).alias("answer_parts"),
        none.alias("fallback_parts"),
        F.when(assistant, tools).otherwise(none).alias("tool_parts"),
        millis(text_at(v, "$.timestamp")).alias("ts"),
        *([F.when(user, rendered("User")).when(assistant, rendered("Assistant")).otherwise(none).alias("items")] if items else []),
        *_said_of_file(v),
    )


def meta_a(facts: DataFrame) -> DataFrame:
    """One row per file: independent firsts of session, directory and sidechain flag."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line")))
    return facts.groupBy("archive_path").agg(
        first("line_session").alias("session_id"),
        first("line_cwd").alias("cwd"),
        (F.first("path_sidechain") | F.coalesce(first("line_sidechain"), F.lit(False))).alias("is_sidechain"),
    )


def file_meta_a(lines: DataFrame) -> DataFrame:
    """As ``meta_a``, from parsed lines, with all columns that both providers know of a file."""
    facts = lines.select("archive_path", "line", *_said_of_file(F.col("v")))
    flag = F.min_by("line_sidechain", F.when(F.col("line_sidechain").isNotNull(), F.col("line")))
    known = facts.groupBy("archive_path").agg(flag.isNotNull().alias("sidechain_known"))
    none = {"agent_path": F.lit(None).cast("string"), "signal": F.lit(None).cast("int"), "header": F.lit(None).cast("boolean")}
    return meta_a(facts).join(known, "archive_path").withColumns(none)


SIGNALS = ["response_item", "user_message", "item_completed"]


def _completed_user(v: Column) -> Column:
    return _is(v, "$.type", "event_msg") & _is(v, "$.payload.type", "item_completed") & _is(v, "$.payload.item.type", "UserMessage")


def meta_b(lines: DataFrame) -> DataFrame:
    """One row per file: the first header, and the strongest user signal of all lines (0, 1, 2)."""
    v = F.col("v")
    head = _is(v, "$.type", "session_meta")
    sub = F.try_variant_get(v, "$.payload.source.subagent", "variant")
    is_sub = F.coalesce(F.schema_of_variant(sub) != "VOID", F.lit(False))
    header = F.struct(text_at(v, "$.payload.id").alias("session_id"), text_at(v, "$.payload.cwd").alias("cwd"), is_sub.alias("is_sidechain"), text_at(v, "$.payload.source.subagent.thread_spawn.agent_path").alias("agent_path"))
    signal = F.when(_completed_user(v), 2).when(_is(v, "$.type", "event_msg") & _is(v, "$.payload.type", "user_message"), 1).otherwise(0)
    got = lines.select("archive_path", "line", F.when(head, header).alias("h"), signal.alias("signal"))
    got = got.groupBy("archive_path").agg(F.min_by("h", F.when(F.col("h").isNotNull(), F.col("line"))).alias("h"), F.max("signal").alias("signal"))
    return got.select("archive_path", "h.session_id", "h.cwd", F.coalesce("h.is_sidechain", F.lit(False)).alias("is_sidechain"), "h.agent_path", "signal", F.col("h").isNotNull().alias("header"))


def facts_b(lines: DataFrame, meta: DataFrame, items: bool = True) -> DataFrame:
    """Line facts of provider B from parsed lines and the files' signals; ``items`` as for provider A."""
    v = F.col("v")
    response, event = _is(v, "$.type", "response_item"), _is(v, "$.type", "event_msg")
    kind = lambda k: _is(v, "$.payload.type", k)
    role = lambda r: _is(v, "$.payload.role", r)
    bs = blocks(v, "$.payload.content")
    typed = block_texts(bs, "input_text", "\n")
    start = (
        F.when(F.col("agent_path").isNotNull(), F.when(response & kind("agent_message") & (text_at(v, "$.payload.recipient") == F.col("agent_path")), typed))
        .when(F.col("signal") == 2, F.when(_completed_user(v), block_texts(blocks(v, "$.payload.item.content"), "text", "\n")))
        .when(F.col("signal") == 1, F.when(event & kind("user_message"), text_at(v, "$.payload.message")))
        .otherwise(F.when(response & kind("message") & role("user") & ~starts_with_any(left_trimmed(typed), NOT_TYPED_B), typed))
    )
    answer = F.when(response & kind("message") & role("assistant"), block_texts(bs, "output_text", "\n\n"))
    fallback = F.when(event & kind("agent_message") & (text_at(v, "$.payload.message") != ""), text_at(v, "$.payload.message"))
    call = kind("function_call") | kind("custom_tool_call")
    tool = F.when(response & call, text_at(v, "$.payload.name")).when(response & kind("local_shell_call"), SHELL)
    item = F.lit(None).cast("string") if not items else (
        F.when(kind("message") & role("user"), item_text("User", block_texts(bs, "input_text", "\n\n")))
        .when(kind("message") & role("assistant"), item_text("Assistant", block_texts(bs, "output_text", "\n\n")))
        .when(kind("function_call"), item_tool(text_at(v, "$.payload.name"), display(v, "$.payload.arguments")))
        .when(kind("custom_tool_call"), item_tool(text_at(v, "$.payload.name"), display(v, "$.payload.input")))
        .when(kind("local_shell_call"), item_tool(F.lit(SHELL), display(v, "$.payload.action")))
        .when(kind("function_call_output") | kind("custom_tool_call_output"), item_result(display(v, "$.payload.output")))
    )
    return lines.join(meta.select("archive_path", "agent_path", "signal"), "archive_path", "left").select(
        "archive_path",
        "line",
        v.isNull().alias("is_bad"),
        start.alias("start_text"),
        _strings(answer).alias("answer_parts"),
        _strings(fallback).alias("fallback_parts"),
        _strings(tool).alias("tool_parts"),
        millis(text_at(v, "$.timestamp")).alias("ts"),
        *([_strings(F.when(response, item)).alias("items")] if items else []),
    )
