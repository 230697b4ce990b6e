import json
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from braidlog.llm import conversations as c
from braidlog.llm.queries import p6_found
from pyspark.sql import functions as F

D = "/root/testdata/sf0.01"


def moment(text):
    m = re.fullmatch(r"(\d{4}-\d\d-\d\d)[Tt ](\d\d:\d\d:\d\d)([.,]\d+)?\s?([Zz]|[+-]\d\d(?::?\d\d)?)", (text or "").strip(" "))
    if not m:
        return None
    try:
        t = datetime.strptime(m[1] + " " + m[2], "%Y-%m-%d %H:%M:%S")
    except ValueError:
        return None
    z = re.sub("[^0-9]", "", m[4])
    s = 0 if not z else (int(z[:2]) * 3600 + int(z[2:] or 0) * 60) * (-1 if m[4][0] == "-" else 1)
    us = (t - datetime(1970, 1, 1)) // timedelta(microseconds=1) - s * 1_000_000
    return us + int(((m[3] or ".0")[1:7]).ljust(6, "0"))


def brute(claude, modern):
    def load(x):
        try:
            return json.loads(x)
        except (TypeError, ValueError):
            return None

    def solid(x):
        return isinstance(x, str) and bool(re.search(r"[^\s\u200b\ufeff\u0000-\u001f]", x))

    msgs = {}
    sess = {}
    for r in claude:
        if r["sessionId"] is not None:
            sess[r["archive_path"]] = min(sess.get(r["archive_path"], r["sessionId"]), r["sessionId"])
    for r in claude:
        if r["role"] not in (None, "user", "assistant") or r["isMeta"] or r["isCompactSummary"] or r["origin_kind"] not in (None, "human"):
            continue
        v = load(r["content"])
        if solid(v) or isinstance(v, list) and any(isinstance(b, dict) and b.get("type") == "text" and solid(b.get("text")) for b in v):
            k = ("claude", r["archive_path"], r["line"])
            if k not in msgs or r["row_id"] < msgs[k][0]:
                msgs[k] = (r["row_id"], r["role"], moment(r["timestamp"]), r["sessionId"] or sess.get(r["archive_path"]))
    heads = {}
    for r in sorted(modern, key=lambda r: (r["line"], r["row_id"])):
        v = load(r["payload"])
        if r["type"] == "session_meta" and isinstance(v, dict) and isinstance(v.get("id"), str):
            heads.setdefault(r["archive_path"], v["id"])
    for r in modern:
        v = load(r["payload"])
        if r["type"] == "response_item" and isinstance(v, dict) and v.get("type") == "message" and v.get("role") in (None, "user", "assistant"):
            if isinstance(v.get("content"), list) and any(isinstance(b, dict) and solid(b.get("text")) for b in v["content"]):
                k = ("modern", r["archive_path"], r["line"])
                if k not in msgs or r["row_id"] < msgs[k][0]:
                    msgs[k] = (r["row_id"], v.get("role"), moment(r["timestamp"]), heads.get(r["archive_path"]))
    convs = defaultdict(list)
    for (t, a, n), (rid, role, at, s) in msgs.items():
        if s is not None:
            convs[t, s].append((at, a, n, rid, role))
    out = Counter()
    for (t, s), ms in convs.items():
        if any(m[0] is None or m[4] is None for m in ms):
            continue
        ms.sort()
        roles = [m[4] for m in ms]
        if roles[0] == "user" and roles[-1] == "assistant" and ("user", "user") not in set(zip(roles, roles[1:])):
            out.update((t, s, i, m[3]) for i, m in enumerate(ms))
    return out


def test_found_equals_brute_force(spark):
    import pyarrow.parquet as pq

    want = brute(pq.read_table(f"{D}/claude.parquet").to_pylist(), pq.read_table(f"{D}/modern.parquet").to_pylist())
    got = Counter(map(tuple, p6_found(spark, D).select("tbl", "session_id", "pos", "row_id").collect()))
    assert got == want and want


@pytest.mark.parametrize("text,good", [
    ("2025-01-01T10:00:00Z", True), ("2025-01-01T10:00:00.123456+05:30", True), ("2025-01-01 10:00:00 +0100", True), ("2025-02-30T10:00:00Z", False),
    ("2025-01-01T10:00:00", False), ("2025-01-01T25:00:00Z", False), ("yesterday", False), ("1735700000", False), ("", False), (None, False), ("2024-02-29T23:59:59-08:00", True),
])
def test_instants(spark, text, good):
    got = spark.createDataFrame([(text,)], "t string").select(c.instant(F.col("t"))).first()[0]
    assert got == moment(text) and (got is not None) is good


SCHEMA = "tbl string, session_id string, at bigint, archive_path string, line bigint, row_id bigint, role string, extra string"


def kept(spark, rows):
    return sorted(map(tuple, c.kept_conversations(spark.createDataFrame(rows, SCHEMA)).collect()))


def test_automaton_over_parts(spark):
    """A session far larger than the others is spread over tasks and kept whole; broken ones go."""
    big = [("claude", "big", i, "a", i, i, "user" if i % 2 == 0 else "assistant", "x") for i in range(4000)]
    bad = [("claude", "bad", i, "b", i, 10_000 + i, "user" if i % 2 == 0 or i == 1501 else "assistant", None) for i in range(3000)]
    other = [("modern", "one", 1, "c", 1, 20_000, "user", None), ("modern", "two", 1, "d", 1, 20_001, "assistant", None), ("modern", "two", 2, "d", 2, 20_002, "user", None),
             ("claude", "norole", 1, "e", 1, 1, "user", None), ("claude", "norole", 2, "e", 2, 2, None, None), ("claude", "notime", None, "f", 1, 3, "user", None), ("claude", "notime", 5, "f", 2, 4, "assistant", None),
             ("claude", None, 1, "g", 1, 5, "user", None), ("claude", "tie", 1, "h", 2, 7, "assistant", None), ("claude", "tie", 1, "h", 1, 6, "user", None)]
    got = kept(spark, big + bad + other)
    assert [x[2:4] for x in got if x[1] == "big"] == [(i, i) for i in range(4000)]
    assert {x[1] for x in got} == {"big", "tie"}
    assert [x[2:5] for x in got if x[1] == "tie"] == [(0, 6, "user"), (1, 7, "assistant")]


def test_empty(spark):
    assert kept(spark, []) == []
