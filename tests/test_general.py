"""Drifting schemas and nested records."""

import json
from collections import Counter, defaultdict

import pytest
from braidlog.functions import jsontext
from braidlog.operators import drift, nesting
from braidlog.plans import general
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

LINES = "row_id bigint, archive_path string, line bigint, type string, payload string, v string"
REG = [("t", "a", "payload.x", "string", True), ("t", "a", "payload.y", "number", False), ("t", "a", "payload.item", "object", True), ("t", "a", "payload.item.k", "array", True)]


def kind(v):
    return "string" if isinstance(v, str) else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "object" if isinstance(v, dict) else "array"


def brute(rows, registry):
    """By the words of the definition, line after line."""
    groups = defaultdict(list)
    for r in rows:
        try:
            p = json.loads(r[4])
        except (TypeError, ValueError):
            continue
        if not isinstance(p, dict) or r[3] is None or r[1] is None:
            continue
        t = r[3] + (("/" + p["type"]) if r[3] in drift.TYPED and isinstance(p.get("type"), str) else "")
        m = {f"payload.{k}": kind(v) for k, v in p.items() if v is not None}
        if isinstance(p.get("item"), dict):
            m |= {f"payload.item.{k}": kind(v) for k, v in p["item"].items() if v is not None}
        groups[r[1], t].append(m)
    out = Counter()
    for (a, t), ms in groups.items():
        reg = {f: (k, q) for _, rt, f, k, q in registry if rt == t}
        on = defaultdict(set)
        kinds = defaultdict(set)
        for i, m in enumerate(ms):
            for f, k in m.items():
                on[f].add(i)
                kinds[f].add(k)
        every, new_names = set(range(len(ms))), set()
        for f, (k, q) in reg.items():
            if kinds[f] - {k}:
                out["t", a, t, f, "retyped"] += 1
            if q and on[f] != every:
                c = [u for u in on if u not in reg and u.rsplit(".", 1)[0] == f.rsplit(".", 1)[0] and kinds[u] == {k} and on[u] == every - on[f]]
                if len(c) == 1:
                    out["t", a, t, f, "renamed"] += 1
                    new_names.add(c[0])
                elif not on[f]:
                    out["t", a, t, f, "missing"] += 1
        for u in on:
            if on[u] and u not in reg and u not in new_names:
                out["t", a, t, u, "added"] += 1
    return out


def found(spark, rows, registry=REG):
    lines = drift.parsed_lines(spark.createDataFrame(rows, LINES), "t")
    reg = spark.createDataFrame(registry, "tbl string, record_type string, field_path string, json_type string, required boolean")
    per_file = drift.file_versions(drift.shapes(lines))
    changes = drift.changes(drift.known_versions(per_file), reg)
    return Counter(tuple(r) for r in drift.of_files(changes, per_file).select("tbl", "archive_path", "record_type", "field_path", "change").collect()), lines, per_file, changes


def row(i, a, p, t="a"):
    return (i, a, i, t, p if isinstance(p, str) or p is None else json.dumps(p), "clash")


def test_changes_equal_brute_force(spark):
    import random

    r = random.Random(4)
    rows = []
    for i in range(600):
        p = {}
        for f, alt in (("x", "x2"), ("y", "y2"), ("z", "z2")):
            if r.random() < 0.8:
                p[f if r.random() < 0.9 else alt] = r.choice(["s", "s", "s", 1, 2.5, True, None, [1], {"q": 1}])
        if r.random() < 0.9:
            p["item"] = r.choice([{"k": [1]}, {"k2": [1]}, {"k": "s"}, {"k": None, "m": 1}, "text", None])
        rows.append(row(i, f"f{r.randrange(60)}", p))
    rows += [row(1000, "f1", "{cut"), row(1001, "f1", None), row(1002, "f2", "[1]"), row(1003, None, {"x": "s"}), row(1004, "f3", {"x": "s"}, None), row(1005, "g", {"x": "s", "item": {"k": []}}), row(1006, "g", {"x": "s", "item": {"k": []}})]
    got, *_ = found(spark, rows)
    assert got == brute(rows, REG) and {c for *_, c in got} == {"retyped", "renamed", "missing", "added"} and not any(k[1] == "g" for k in got)


def test_rename_default_and_cast(spark):
    rows = [row(1, "f", {"x": "a", "item": {"k": [1]}}), row(2, "f", {"x2": "b", "y": "12", "item": {"k": [2]}}), row(3, "f", {"x": "c", "y": True, "item": "no"}), row(4, "f", "{"), row(5, "f", {"x": 7, "item": {"k": []}})]
    got, lines, per_file, changes = found(spark, rows)
    assert ("t", "f", "a", "payload.x", "renamed") in got
    members = [(r[2], r[3]) for r in REG]
    table = drift.consistent_table(lines, per_file, drift.steps(changes), members)
    out = {r["row_id"]: r for r in table.collect()}
    assert [out[i]["payload_x"] for i in (1, 2, 3, 4, 5)] == ["a", "b", "c", None, "7"] and out[2]["payload_y"] == 12.0
    assert out[1]["payload_item_k"] == "[1]" and not out[4]["readable"]
    assert json.loads(out[3]["rest"])["payload.item"] == '"no"' and "payload.item" in out[3]["failed"].split(",")
    assert "rename payload.x" in out[2]["applied"] and "cast payload.x" in out[5]["applied"] and out[1]["rest"] == "{}" and out[1]["version"] == out[5]["version"]
    given = drift.consistent_table(lines, per_file, drift.steps(changes), members, {"payload.y": "5"})
    assert {r["row_id"]: r["payload_y"] for r in given.collect()}[1] == 5.0


def test_nothing_is_lost_in_the_table(spark):
    """Every non-null member is in a column, or in ``rest``; a value that can't be cast is named and kept."""
    rows = [row(1, "f", {"x": "a", "y": "no number", "z": "s", "u": [{"v": 1}]}), row(2, "g", {"x": "a", "y": [1], "item": {"k": "text", "m": 2}}), row(3, "g", {"x": None, "y": 3})]
    _, lines, per_file, changes = found(spark, rows)
    out = {r["row_id"]: r for r in drift.consistent_table(lines, per_file, drift.steps(changes), [(r[2], r[3]) for r in REG]).collect()}
    assert out[1]["failed"] == "payload.y" and json.loads(out[1]["rest"])["payload.y"] == '"no number"' and json.loads(json.loads(out[1]["rest"])["payload.u"]) == [{"v": 1}]
    assert set(out[2]["failed"].split(",")) == {"payload.y", "payload.item.k"} and {"payload.y", "payload.item.k", "payload.item.m"} <= set(json.loads(out[2]["rest"]))
    assert out[3]["failed"] == "" and out[3]["payload_y"] == 3.0


def test_versions_and_steps(spark):
    """Files written alike share a version; versions are numbered by first appearance and know their differences and steps."""
    rows = [row(i, a, p) for i, (a, p) in enumerate([("f", {"x": "a", "y": 1, "item": {"k": []}}), ("g", {"x": "b", "y": 2, "item": {"k": []}}), ("h", {"x2": "c", "y": 3, "item": {"k": []}})])]
    df = spark.createDataFrame([(*r[:5], f"2025-01-0{i + 1} 00:00:00") for i, r in enumerate(rows)], "row_id bigint, archive_path string, line bigint, type string, payload string, ingested_at string").withColumn("ingested_at", F.col("ingested_at").cast("timestamp_ntz"))
    per_file = drift.file_versions(drift.shapes(drift.parsed_lines(df, "t")))
    v1, v2 = drift.versions(per_file).orderBy("version").collect()
    assert (v1["version"], v1["n_files"], v2["version"], v2["gained"], v2["lost"]) == (1, 2, 2, "payload.x2:string", "payload.x:string")
    reg = spark.createDataFrame(REG, "tbl string, record_type string, field_path string, json_type string, required boolean")
    steps = drift.steps(drift.changes(drift.known_versions(per_file), reg)).where(F.col("fingerprint") == v2["fingerprint"]).orderBy("place", "field_path").collect()
    assert ("rename", "payload.x", "payload.x2") in [(r["rule"], r["field_path"], r["argument"]) for r in steps] and [r["place"] for r in steps] == sorted(r["place"] for r in steps)


def test_empty_tables(spark):
    assert found(spark, [])[0] == Counter()
    assert nesting.occurrences(spark.createDataFrame([], "row_id bigint, c string"), "t", "row_id", "c").collect() == []


def paths(value, base):
    out = []
    if isinstance(value, dict):
        for k, v in value.items():
            out += paths(v, f"{base}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            if isinstance(v, dict):
                out.append(f"{base}[{i}]")
            out += paths(v, f"{base}[{i}]")
    return out


JSON = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text("ab", max_size=2), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["a", "b", "c"]), x, max_size=3), max_leaves=14)


@settings(max_examples=300, deadline=None)
@given(JSON)
def test_walk_finds_all_elements(value):
    found, nodes = nesting.walk(value, "p")
    assert sorted(r[0] for r in found if r[4]) == sorted(paths(value, "p"))
    assert all(r[5] in nodes for r in found)


@settings(max_examples=300, deadline=None)
@given(JSON, JSON)
def test_equal_objects_and_only_they_share_an_identity(x, y):
    (a, _), (b, _) = nesting.walk({"v": x}, "p"), nesting.walk({"v": y}, "p")
    shuffled, _ = nesting.walk(json.loads(json.dumps({"v": x}, sort_keys=True)), "p")
    assert a[0][5] == shuffled[0][5]
    assert (a[0][5] == b[0][5]) == (json.dumps(x, sort_keys=True) == json.dumps(y, sort_keys=True))


@settings(max_examples=300, deadline=None)
@given(JSON)
def test_nodes_and_links_rebuild_the_value(value):
    found, nodes = nesting.walk({"v": value}, "p")

    def build(ident):
        body, links = nodes[ident]
        out = json.loads(body)
        for member, ordinals, child in links:
            if not ordinals:
                out[member] = build(child)
                continue
            at = out[member]
            *way, last = [int(i) for i in ordinals.split(",")]
            for i in way:
                at = at[i]
            at[last] = build(child)
        return out

    assert build(found[0][5]) == {"v": value}


def test_nesting_edges(spark):
    deep = "[" * 5000 + '{"a":[{"b":1}]}' + "]" * 5000
    rows = [(1, '[{"a":[{"b":1}]},{"b":1}]', "x"), (2, '[{"a":[{"b":1}]},{"b":1}]', None), (3, None, "x"), (4, "", "x"), (5, "[{", "x"), (6, '"[{}]"', "x"), (7, deep, "x"), (8, "{}", "x"), (9, "[NaN,{}]", "x")]
    df = spark.createDataFrame(rows, "row_id bigint, c string, path string")
    got = nesting.occurrences(df, "t", "row_id", "c").where("in_array").collect()
    by = defaultdict(set)
    for r in got:
        by[r["row_id"]].add((r["path"], r["parent_path"], r["ordinal"]))
    assert by[1] == by[2] == {("c[0]", None, 0), ("c[0].a[0]", "c[0]", 0), ("c[1]", None, 1)} and len(by[7]) == 2 and set(by) == {1, 2, 7}
    assert nesting.nodes(df.where("row_id < 3"), "c").count() == 2 and nesting.bridge(df.where("row_id < 3"), "c").count() == 1


def test_all_objects_of_both_tables_have_nodes_and_links(spark, tmp_path):
    both = '{"a":[{"b":1}]}'
    spark.createDataFrame([(1, "f", 1, f"[{both}]"), (2, "f", 2, '{"only":{"claude":1}}')], "row_id bigint, archive_path string, line bigint, content string").write.parquet(f"{tmp_path}/claude.parquet")
    spark.createDataFrame([(1, "g", 1, both), (2, "g", 2, '{"item":{"modern":[{"x":2}]}}'), (3, "g", 3, None)], "row_id bigint, archive_path string, line bigint, payload string").write.parquet(f"{tmp_path}/modern.parquet")
    objects = general.p5_objects(spark, str(tmp_path)).collect()
    nodes = [r["node_id"] for r in general.p5_nodes(spark, str(tmp_path)).collect()]
    assert {r["tbl"] for r in objects} == {"claude", "modern"} and len(nodes) == len(set(nodes)) == 7 and set(nodes) == {r["node_id"] for r in objects}
    at = {(r["tbl"], r["row_id"], r["path"]): r["node_id"] for r in objects}
    links = [(r["parent_id"], r["member"], r["child_id"]) for r in general.p5_bridge(spark, str(tmp_path)).collect()]
    assert len(links) == len(set(links)) == 4 and set(links) == {(at[r["tbl"], r["row_id"], r["parent_path"]], r["member"], r["node_id"]) for r in objects if r["parent_path"]}


@settings(max_examples=300, deadline=None)
@given(JSON)
def test_parser_without_recursion_agrees(value):
    for text in (json.dumps(value), json.dumps(value, indent=2), " " + json.dumps(value) + "\n"):
        assert jsontext._deep(text) == value


@pytest.mark.parametrize("text", ["", "{", "[1,]", '{"a"}', "nul", "01", "[1 2]", '"\n"', "{1:2}", "[]]", "NaN"])
def test_no_json(text):
    for read in (jsontext.loads, jsontext._deep):
        with pytest.raises(ValueError):
            read(text)


def test_numbers_and_variants(spark):
    df = spark.createDataFrame([('{"a":1,"b":2.5,"c":1e30,"d":"x","e":[],"f":{},"g":true,"h":null}',)], "j string").select(F.try_parse_json("j").alias("v"))
    m = df.select(F.transform_values(F.try_variant_get("v", "$", "map<string,variant>"), lambda k, x: drift._kind(x))).first()[0]
    assert m == {"a": "number", "b": "number", "c": "number", "d": "string", "e": "array", "f": "object", "g": "boolean", "h": None}


def test_columns_are_replaced_in_place(spark):
    from braidlog.functions.arrow import replace_columns

    df = spark.createDataFrame([(1, "a", "x", [1]), (1, None, "y", None)], "id bigint, t string, s string, l array<int>")
    out = replace_columns(df, ["t"], lambda: lambda v: None if v is None else v + "!")
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "a!", "x", [1]), (1, None, "y", None)] and out.schema == df.schema
    assert replace_columns(df.where("false"), ["t"], lambda: str).collect() == []


def test_occurrences_carry_columns_of_their_row(spark):
    df = spark.createDataFrame([(1, '[{"a": {}}]', 7, "f"), (1, '[{}]', 8, None)], "row_id bigint, c string, line bigint, path string").withColumnRenamed("path", "archive_path")
    got = nesting.occurrences(df, "t", "row_id", "c", "archive_path string, line bigint").collect()
    assert sorted((r["path"], r["line"], r["archive_path"]) for r in got if r["line"] == 7) == [("c[0]", 7, "f"), ("c[0].a", 7, "f")] and len(got) == 3
