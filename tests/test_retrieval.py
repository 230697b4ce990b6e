"""Ranking, search, reading, catalog: the behaviours that are easy to get wrong, with exact numbers."""

import math
from dataclasses import dataclass

import pytest
from braidlog.functions import text as tx
from braidlog.functions.timefn import local_day, midnight_millis, millis, strict_day
from braidlog.operators import catalog, fulltext, fusion, reading, vectors
from braidlog.operators import exchanges as ex
from braidlog.operators.index import TextIndex
from braidlog.plans import reference
from braidlog.search import Engine, checked_limit, checked_queries
from pyspark.sql import functions as F

COLUMNS = "id bigint, archive_path string, line_start bigint, line_end bigint, session_id string, project string, is_sidechain boolean, ts bigint, user_message string, assistant_message string"


def corpus(spark, rows):
    """rows: (id, text) or (id, text, dict of other columns)."""
    out = []
    for r in rows:
        o = {"archive_path": f"a{r[0]}", "session_id": None, "project": "p", "is_sidechain": False, "ts": 1_700_000_000_000, **(r[2] if len(r) > 2 else {})}
        out.append((r[0], o["archive_path"], 1, 2, o["session_id"], o["project"], o["is_sidechain"], o["ts"], r[1], ""))
    return spark.createDataFrame(out, COLUMNS)


def axis(cos):
    return [float(cos), math.sqrt(1 - cos * cos)]


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, axis(c), p, t, False) for i, c, p, t in rows], "id bigint, embedding array<float>, project string, ts bigint, is_sidechain boolean")


def found(engine, *a, **k):
    return [(r["exchange_id"], r["score"]) for r in engine.search(*a, **k).hits.collect()]


FILL = [(i, f"filler text number {i}") for i in range(100, 130)]
KW1, VEC1 = 0.4 / 61 + 0.01, 0.6 / 61


def test_tokens(spark):
    def t(s):
        return spark.range(1).select(tx.tokens(F.lit(s))).first()[0]

    assert t("C++ foo-bar a:b API검색 검색추천 값") == ["c", "foo", "bar", "a", "b", "api", "검색", "검색", "색추", "추천", "값"]
    assert spark.range(1).select(tx.hangul_terms(F.lit("API검색 x 검"))).first()[0] == "API 검색  x 검"
    assert t("") == [] == t("!!!") and fulltext.query_tokens("a B a 값") == [fulltext.Token("a"), fulltext.Token("b"), fulltext.Token("값", True)]
    words = "caresses ponies cats feed agreed plastered motoring sing conflated troubled hopping falling filing happy relational conditional digitizer triplicate formative hopeful revival adjustment adoption probate rate controll".split()
    stems = "caress poni cat feed agre plaster motor sing conflat troubl hop fall file happi relat condit digit triplic form hope reviv adjust adopt probat rate control".split()
    assert [tx.porter(w) for w in words] == stems


def test_text_functions(spark):
    df = spark.createDataFrame([("aé€𝄞x",), ("",), (None,)], "t string")
    for n in range(0, 14):
        want = []
        for s in ("aé€𝄞x", "", None):
            raw = None if s is None else s.encode()
            want.append(s if raw is None or len(raw) <= n else raw[:n].decode(errors="ignore") + tx.CUT_MARK)
        assert [r[0] for r in df.select(tx.cut_bytes(F.col("t"), n)).collect()] == want
    one = spark.range(1)
    assert one.select(tx.one_line(F.lit("  a \n b\t"))).first()[0] == "a b"
    assert [r for r in one.select(tx.generation(F.lit("x.gen-12.jsonl")), tx.generation(F.lit("x.gen-y.jsonl")), tx.base_path(F.lit("d/x.gen-3.jsonl")), tx.archive_name(F.lit("k"), F.lit("d/x.jsonl"), F.lit(2))).first()] == [12, 0, "d/x.jsonl", "conversation-archive/k/d/x.gen-2.jsonl"]
    assert [tx_ for tx_ in one.select(*[tx.project_of(F.lit(c)) for c in ("/srv/work/x", "/", "", None)]).first()] == ["x", "unknown", "unknown", "unknown"]


@pytest.mark.parametrize("t,ms", [("2025-01-01T00:00:00Z", 1735689600000), ("2025-01-01T09:00:00.5+09:00", 1735689600500), ("2025-01-01T00:00:00", 0), ("yesterday", 0), (None, 0), ("2025-13-01T00:00:00Z", 0)])
def test_instants(spark, t, ms):
    assert spark.createDataFrame([(t,)], "t string").select(millis(F.col("t"))).first()[0] == ms


def test_midnight_over_a_gap(spark):
    """São Paulo had no midnight on 4 November 2018."""
    day = strict_day("2018-11-04")
    assert spark.range(1).select(midnight_millis(day, "America/Sao_Paulo")).first()[0] == 1541300400000
    with pytest.raises(ValueError):
        strict_day("2018-1-04")


def test_keyword_scores(spark):
    e = Engine(corpus(spark, [(1, "zebra"), (2, "zebra zebra zebra"), *FILL]))
    got = found(e, "zebra")
    assert [i for i, _ in got] == [2, 1] and got[0][1] == pytest.approx(KW1 / fusion.BEST, abs=1e-9)
    assert got[1][1] == pytest.approx((0.4 / 62 + 0.005) / fusion.BEST, abs=1e-9)
    assert [i for i, _ in found(Engine(corpus(spark, [(1, "zebra"), (2, "zebra"), *FILL])), "zebra")] == [1, 2]


def index(spark, rows, stem=True):
    return TextIndex.of(corpus(spark, rows).select("id", "project", "ts", F.col("user_message").alias("text")), stem)


def test_common_tokens(spark):
    i = index(spark, [(1, "filler zebra"), *FILL])
    # common ones go; if nothing left matches, the rarer of them comes back (30 texts against 31)
    for query, kept in (("filler zebra", [1]), ("filler text", [1]), ("text filler", [0]), ("filler nothing", [0, 1]), ("nothing", [0])):
        assert i.plan(query).kept == kept, query
    many = spark.createDataFrame([(k, q) for k, q in enumerate(["filler zebra", "filler text", "text filler", "filler nothing", "nothing", "!!"])], "query_id bigint, query string")
    got = i.best_of_many(many, 40).collect()
    for k, q in enumerate(["filler zebra", "filler text", "text filler", "filler nothing", "nothing"]):
        assert sorted((r["rank"], r["id"], r["score"]) for r in got if r["query_id"] == k) == sorted((r["rank"], r["id"], r["score"]) for r in i.best(q, 40).collect()), q
    assert all(r["query_id"] != 5 for r in got)


def test_stems_marks_and_prefixes(spark):
    rows = [(1, "searching the caches"), (2, "Café search"), (3, "값이 검색추천"), (4, None), (5, "값 값지다"), *FILL]
    i = index(spark, rows)
    best = lambda q: [r["id"] for r in i.best(q, 10).orderBy("rank").collect()]
    assert best("searches") == [2, 1] and best("cafe") == [2] and best("cache") == [1] and best("검색") == [3] and set(best("값")) == {3, 5}
    assert i.total == 35 and [r["id"] for r in index(spark, rows, False).best("searches", 10).collect()] == []
    many = spark.createDataFrame([(1, "값"), (2, "searches 값")], "query_id bigint, query string")
    for k, q in ((1, "값"), (2, "searches 값")):
        assert {(r["id"], r["score"], r["rank"]) for r in i.best_of_many(many, 10).where(f"query_id = {k}").collect()} == {(r["id"], r["score"], r["rank"]) for r in i.best(q, 10).collect()}


def test_bm25_by_hand(spark):
    """Scores of the kept index equal the formula, computed from tokens in Python, filters or not."""
    import random

    r = random.Random(2)
    texts = {k: " ".join(r.choice("ant bee cow dog eel fox gnu hen".split()) for _ in range(r.randint(0, 12))) for k in range(60)}
    i = index(spark, [(k, t, {"project": "p" if k % 3 else "q"}) for k, t in texts.items()], False)
    words = {k: t.split() for k, t in texts.items()}
    total, avgdl = len(texts), sum(map(len, words.values())) / len(texts)
    n = {w: sum(w in x for x in words.values()) for w in ("ant", "bee")}
    want = {}
    for k, x in words.items():
        part = [max(math.log((total - n[w] + 0.5) / (n[w] + 0.5)), 1e-6) * x.count(w) * 2.2 / (x.count(w) + 1.2 * (0.25 + 0.75 * len(x) / avgdl)) for w in n]
        if any(part):
            want[k] = round(sum(part), 9)
    p = i.plan("ant bee")
    both = type(p)(p.terms, p.df, [0, 1])
    assert p.df == [n["ant"], n["bee"]]
    assert {r["id"]: r["score"] for r in i.scored(both).collect()} == pytest.approx(want) and {r["id"] for r in i.scored(both, F.col("project") == "q").collect()} == {k for k in want if k % 3 == 0}


def test_a_kept_index_reads_its_terms_only(spark, tmp_path):
    rows = [(k, " ".join(f"w{(k * 7 + j) % 400}" for j in range(20))) for k in range(400)]
    texts = corpus(spark, rows).select("id", "project", "ts", F.col("user_message").alias("text"))
    i = TextIndex.write(texts, str(tmp_path / "index"), False)
    again = TextIndex.open(spark, str(tmp_path / "index"), False)
    assert [tuple(r) for r in again.best("w5 w9", 7).collect()] == [tuple(r) for r in TextIndex.of(texts, False).best("w5 w9", 7).collect()] and i.total == 400
    p = plan_of(again.scored(again.plan("w5 w9"), F.col("project") == "p"))
    assert "In(term, [w5,w9])" in p and "EqualTo(project,p)" in p and "ReadSchema: struct<term:string,id:bigint,tf:int,dl:int,project:string>" in p
    e = Engine(corpus(spark, rows), index=again)
    assert e.search("w5", limit=3).hits.count() == 3


def test_floor_then_rank_and_keyword_exemption(spark):
    e = Engine(corpus(spark, [(1, "zebra"), (2, "b"), (3, "c"), *FILL]), vectors_of(spark, [(1, 0.10, "p", 0), (2, 0.9, "p", 0), (3, 0.5, "p", 0)]), lambda q: axis(1.0))
    got = dict(found(e, "zebra"))
    assert set(got) == {1, 2}  # 3 is below the floor; 1 is exempt, and has the second vector rank behind 2
    assert got[1] == pytest.approx((KW1 + 0.6 / 62) / fusion.BEST, abs=1e-9) and got[2] == pytest.approx(VEC1 / fusion.BEST, abs=1e-9)
    both = Engine(corpus(spark, [(1, "zebra"), *FILL]), vectors_of(spark, [(1, 0.95, "p", 0)]), lambda q: axis(1.0))
    assert found(both, "zebra") == [(1, pytest.approx(1.0))]


def test_penalty_after_bonus_flips_the_order(spark):
    rows = [(1, "zebra zebra", {"is_sidechain": True}), (2, "zebra"), *FILL]
    got = dict(found(Engine(corpus(spark, rows)), "zebra"))
    assert got[1] == pytest.approx(0.9 * KW1 / fusion.BEST, abs=1e-9)
    near = Engine(corpus(spark, [(1, "a", {"is_sidechain": True}), (2, "b"), *FILL]), vectors_of(spark, [(1, 0.99, "p", 0), (2, 0.98, "p", 0)]), lambda q: axis(1.0))
    assert [i for i, _ in found(near, "nothing")] == [2, 1]


def test_several_concepts(spark):
    rows = [(1, "zebra", {"archive_path": "x"}), (2, "yak", {"archive_path": "x"}), (3, "zebra yak", {"archive_path": "y"}), (4, "zebra", {"archive_path": "z"}), *FILL]
    e = Engine(corpus(spark, rows))
    got = found(e, ["zebra", "yak"])
    # x: both concepts at rank 1, of two equal exchanges the larger id is shown; y: ranks 3 and 2
    low = (0.4 / 63 + 0.0025 + 0.4 / 62 + 0.005) / 2
    assert got == [(2, pytest.approx(KW1 / fusion.BEST, abs=1e-9)), (3, pytest.approx(low / fusion.BEST, abs=1e-9))]
    assert found(e, ["zebra", "!!!"]) == [] and e.search("!!!").vector_used is False


def test_filters_and_exclusion(spark):
    day = 86_400_000
    rows = [(1, "zebra", {"project": "q", "ts": 1_735_689_600_000}), (2, "zebra", {"ts": 1_735_689_600_000 + day}), (3, "zebra", {"session_id": "me"}), (4, "zebra", {"session_id": None}), *FILL]
    e = Engine(corpus(spark, rows))
    assert [i for i, _ in found(e, "zebra", project="q")] == [1]
    assert {i for i, _ in found(e, "zebra", after="2025-01-01", before="2025-01-01")} == {1} and {i for i, _ in found(e, "zebra", after="2025-01-02")} == {2}
    assert {i for i, _ in found(e, "zebra", exclude_session="me")} == {1, 2, 4}
    score = dict(found(e, "zebra", project="q"))[1]
    assert score == pytest.approx(KW1 / fusion.BEST, abs=1e-9)


def test_arguments():
    assert [checked_limit(x) for x in (0, 1, 100)] == [1, 1, 50]
    for bad in ("", "  ", [], ["a"], ["a"] * 6, ["a", " "]):
        with pytest.raises(ValueError):
            checked_queries(bad)
    for bad in (True, 1.5, "3"):
        with pytest.raises(ValueError):
            checked_limit(bad)


def test_broken_model_falls_back(spark):
    def broken(_):
        raise RuntimeError("no model")

    e = Engine(corpus(spark, [(1, "zebra"), *FILL]), vectors_of(spark, [(1, 1.0, "p", 0)]), broken)
    a = e.search("zebra")
    assert not a.vector_used and a.notes == ["keywords only: no model"] and a.hits.first()["keyword_match"]
    assert e.cards(a).first()[0].startswith("1. [p, 2023-11-14, score 0.6")


def test_neighbours(spark):
    v = vectors_of(spark, [(3, 0.5, "p", 0), (1, 0.5, "p", 0), (2, 0.9, "q", 0)])
    got = vectors.nearest(v.select("id", "embedding"), axis(1.0), 2).collect()
    assert [(r["id"], r["rank"]) for r in got] == [(2, 1), (1, 2)] and got[0]["cos"] == pytest.approx(0.9, abs=1e-6)
    zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0])], "id bigint, embedding array<float>")
    assert [(r["id"], r["cos"]) for r in vectors.nearest(zero.where("id = 1"), [1.0, 0.0], 5).collect()] == [(1, 0.5)]
    for bad in (zero, spark.createDataFrame([(1, None)], "id bigint, embedding array<float>")):
        with pytest.raises(Exception, match="hasn't 2 numbers"):
            vectors.nearest(bad, [1.0, 0.0], 5).collect()
    assert vectors.nearest(zero.where("false"), [1.0, 0.0], 5).collect() == []
    many = spark.createDataFrame([(7, axis(1.0)), (8, axis(0.5))], "query_id bigint, embedding array<float>")
    for at_once in (1, 100):
        got = vectors.nearest_of_many(v.select("id", "embedding"), many, 2, at_once).collect()
        assert {(r["query_id"], r["id"], r["rank"]) for r in got} == {(7, 2, 1), (7, 1, 2), (8, 1, 1), (8, 3, 2)}
    assert vectors.nearest_of_many(v.select("id", "embedding"), many.where("false"), 2).collect() == []


def test_embedders_are_plugged_in_and_checked(spark):
    @dataclass(frozen=True)
    class Axis:
        dim: int = 2
        gives: int = 2

        def make(self):
            return lambda texts: [[float(len(t))] * self.gives for t in texts]

    df = spark.createDataFrame([("ab",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(vectors.embed(Axis())(F.col("t"))).collect()] == [[2.0, 2.0], None, [0.0, 0.0]]
    with pytest.raises(Exception, match="some without 2 numbers"):
        df.select(vectors.embed(Axis(gives=3))(F.col("t"))).collect()


def test_days_in_any_session_zone(spark):
    """Days and midnights don't depend on the zone of the session."""
    try:
        for zone in ("UTC", "Asia/Tokyo", "America/Sao_Paulo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            row = spark.range(1).select(midnight_millis(strict_day("2018-11-04"), "America/Sao_Paulo"), midnight_millis(strict_day("2025-03-01"), "America/Sao_Paulo"), local_day(F.lit(1741489200000), "America/Sao_Paulo"), local_day(F.lit(0)), local_day(F.lit(-1))).first()
            assert list(row) == [1541300400000, 1740798000000, "2025-03-09", "1970-01-01", "1969-12-31"], zone
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert vectors._fnv("a") == 0xAF63DC4C8601EC8C and vectors.hashed("!", 8) == [0.0] * 8 and sum(x * x for x in vectors.hashed("A b a", 384)) == pytest.approx(1, abs=1e-6)


def test_search_many_equals_single(spark):
    rows = [(1, "zebra yak"), (2, "zebra"), *FILL]
    e = Engine(corpus(spark, rows))
    qs = spark.createDataFrame([(1, "zebra"), (2, "yak")], "query_id bigint, query string")
    got = {(r["query_id"], r["id"], r["rank"]) for r in e.search_many(qs).collect()}
    assert got == {(1, 2, 1), (1, 1, 2), (2, 1, 1)}


def items(spark, rows):
    return spark.createDataFrame(rows, "archive_path string, line bigint, items array<string>")


def test_pages_cover_all_lines(spark):
    rows = [("f", i, [f"{'x' * (i * 7 % 60)} item {i}"]) for i in range(1, 30) if i % 4] + [("f", 8, [])]
    df, seen, start = items(spark, rows), [], 1
    while start:
        page = reading.pages(df, start, None, 120).orderBy("line").collect()
        assert page and sum(len(r["block"]) for r in page) <= 120 or len(page) == 1
        seen += [r["line"] for r in page]
        start = page[0]["next_line"]
    assert seen == sorted(r[1] for r in rows if r[2])


def test_first_line_is_cut_to_fit(spark):
    df = items(spark, [("f", 1, ["é" * 200]), ("f", 2, ["next"]), ("g", 5, ["z" * 500])])
    got = {r["archive_path"]: r["text"] for r in reading.page_text(reading.pages(df, 1, None, 100)).collect()}
    assert got["f"].startswith("L1 éé") and got["f"].endswith(f"{tx.CUT_MARK}_(continue with startLine=2)_") and got["g"].endswith(tx.CUT_MARK)


def test_reading_is_guarded(spark):
    df = items(spark, [("k/f.jsonl", 1, ["a"])])
    none = spark.createDataFrame([], "archive_path string")
    assert Engine.read(df, "k/f.jsonl", skipped=none).first()["text"] == "L1 a\n\n" == Engine.read(df, "k/f.jsonl", registry=False).first()["text"]
    for bad in ("/etc/passwd", "k/../x", "k//x", "./k", "k\\x"):
        with pytest.raises(ValueError):
            Engine.read(df, bad, skipped=none)
    with pytest.raises(ValueError):
        Engine.read(df, "k/f.jsonl", skipped=none, kinds=["j"])
    assert Engine.read(df, "k/f.jsonl", skipped=none, kinds=["k"]).count() == 1
    with pytest.raises(PermissionError):
        Engine.read(df, "k/f.jsonl")
    out = spark.createDataFrame([("k/f.gen-2.jsonl",)], "archive_path string")
    with pytest.raises(PermissionError):
        Engine.read(df, "k/f.jsonl", skipped=out)


def test_fold_details(spark):
    none = []
    rows = [("f", 1, False, None, none, none, none, 5), ("f", 2, False, "q", none, none, none, 7), ("f", 3, True, None, none, none, none, 0), ("f", 4, False, None, ["", "a"], none, ["T", "U"], 9), ("f", 5, False, None, ["", "b"], ["spare"], ["T"], 9), ("f", 6, False, "open", none, none, none, 9)]
    facts = spark.createDataFrame(rows, "archive_path string, line bigint, is_bad boolean, start_text string, answer_parts array<string>, fallback_parts array<string>, tool_parts array<string>, ts bigint")
    a, b = ex.folded(facts).orderBy("line_start").collect()
    assert (a["line_start"], a["line_end"], a["ts"], a["assistant_message"], a["tool_names"], a["bad_lines"]) == (2, 5, 7, "a\n\n\n\nb", ["T", "U"], 1)
    assert b["assistant_message"] == "" and ex.answered(ex.folded(facts)).count() == 1
    assert ex.folded(facts.where("false")).collect() == []


def test_long_files_are_counted_in_blocks(spark, monkeypatch):
    import random

    r = random.Random(1)
    rows = [(f"f{f}", i, "q" if r.random() < 0.3 else None) for f, n in ((1, 50), (2, 4), (3, 23)) for i in range(1, n) if r.random() < 0.9]
    facts = spark.createDataFrame(rows, "archive_path string, line bigint, start_text string")
    want, seen = {}, {}
    for a, i, s in rows:
        seen[a] = seen.get(a, 0) + (s is not None)
        want[a, i] = seen[a]
    for block in (3, 7, 1000):
        monkeypatch.setattr(ex, "BLOCK", block)
        assert {(x["archive_path"], x["line"]): x["segment"] for x in ex.segments(facts).collect()} == want


def test_ids_follow_the_order(spark):
    rows = [(f"f{i % 7}", i) for i in range(500)]
    got = ex.numbered(spark.createDataFrame(rows, "archive_path string, line_start bigint"), 10).collect()
    ordered = sorted(got, key=lambda r: (r["archive_path"], r["line_start"]))
    assert [r["id"] for r in ordered] == list(range(11, 511))


def test_catalog(spark):
    files = spark.createDataFrame([("s", "r/x.jsonl", 5), ("t", "x.jsonl", 6), ("u", "r/y.jsonl", 7), ("v", "r/z.gen-1.jsonl", 1), ("w", "r/z.jsonl", 2)], "source_path string, archive_path string, end_offset bigint")
    assert [tuple(r) for r in catalog.relative_paths(files, "r/").where("source_path = 'u'").collect()] == [("u", "y.jsonl")]
    assert {r["source_path"] for r in catalog.relative_paths(files, "r/").collect()} == {"u", "v", "w"}
    assert {r["archive_path"] for r in catalog.current_generations(files).collect()} == {"r/x.jsonl", "x.jsonl", "r/y.jsonl", "r/z.gen-1.jsonl"}
    found_ = spark.createDataFrame([("s", 5), ("t", 9), ("n", 1)], "source_path string, size bigint")
    assert {r["source_path"] for r in catalog.changed(found_, files).collect()} == {"t", "n"}
    both = spark.createDataFrame([("s", "q"), ("q", "x.jsonl"), ("q", "q")], "source_path string, archive_path string")
    assert [tuple(r) for r in catalog.unknown(both, files).select("source_path", "archive_path").collect()] == [("q", "q")]
    kv = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    assert {tuple(r) for r in catalog.put(kv, spark.createDataFrame([("b", "3"), ("c", "4")], "key string, value string")).collect()} == {("a", "1"), ("b", "3"), ("c", "4")}


@pytest.mark.parametrize("facts,roots,pending,want", [
    ({}, {"a": False}, 0, {"db": "warn", "last-sync": "warn", "source-roots": "fail", "embeddings": "ok"}),
    ({"revision": "3", "last_sync": "t"}, {"a": True}, 2, {"db": "ok", "last-sync": "ok", "source-roots": "ok", "embeddings": "warn"}),
    ({"revision": "4", "last_error": "x", "last_embed_error": "y"}, {"a": True}, 0, {"db": "fail", "last-sync": "warn", "source-roots": "ok", "embeddings": "warn"}),
])
def test_health(spark, facts, roots, pending, want):
    counted = spark.createDataFrame([(1, 0, 5, pending)], "files bigint, skipped bigint, exchanges bigint, pending bigint")
    got = catalog.health(counted, facts, roots)
    assert {r["name"]: r["level"] for r in got.collect()} == want and catalog.failing(got).first()[0] is ("fail" in want.values())


def test_pending_and_attach(spark):
    e = corpus(spark, [(1, "a"), (2, "b")])
    v = spark.createDataFrame([(1, [1.0]), (9, [1.0])], "id bigint, embedding array<float>")
    assert [r["id"] for r in vectors.pending(e, v).collect()] == [2] and [r["id"] for r in vectors.attach(v, e).collect()] == [1]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    """Filters reach the scan, ranking reads no texts it doesn't need, limits are top-k, nothing is crossed."""
    d = "/root/testdata/sf0.001"
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding", "label")
    p = plan_of(vectors.nearest(e.where("label = 3"), [0.0] * 64, 5))
    assert "PushedFilters: [IsNotNull(label), EqualTo(label,3)]" in p and "TakeOrderedAndProject" in p and "Cartesian" not in p
    x = spark.read.parquet(f"{d}/exchanges.parquet")
    p = plan_of(x.where((F.col("project") == "a") & (F.col("ts") >= 5)).select("id"))
    assert "EqualTo(project,a)" in p and "GreaterThanOrEqual(ts,5)" in p and "user_message" not in p
    p = plan_of(fusion.fused(x.select("id", F.lit(1).alias("rank")), x.select("id", F.lit(2).alias("rank"))))
    assert p.count("hashpartitioning") == 1


def test_whole_texts_are_folded(spark, tmp_path):
    """Against Python's own decomposition, over all languages and letters."""
    import hashlib
    import re
    import unicodedata

    texts = ["École ÀÉÎÕÜ Łódź ŻÓŁW źle", "naïve œuvre Œuvre straße", "Ěščř Ğğ Şş Ňň Űű Ŵŵ Ÿ", "е\u0308лка Ёлка мой", "한국어 말 ①", "cafe\u0301 A\u030angstro\u0308m İstanbul", "", None]
    langs = ["fr", "en", None, "ru", "ko", "de", "es", "en"]
    spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(zip(langs, texts, strict=True))], "doc_id bigint, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def fold(text):
        out = []
        for c in text.lower():
            base = unicodedata.normalize("NFD", c)
            if unicodedata.combining(c):
                if not (out and "a" <= out[-1] <= "z"):
                    out.append(c)
            else:
                out.append(base[0] if "a" <= base[0] <= "z" else c)
        return " ".join(re.findall(r"[^\W_]+", "".join(out)))

    got = {r["id"]: r["digest"] for r in reference.strip_diacritics_tokens(spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else hashlib.md5(fold(t).encode()).hexdigest() for i, t in enumerate(texts)}


def test_cards_keep_all_letters_and_rows(spark, tmp_path):
    rows = [(1, "p", 0, "é\u00a0 ü\n漢", None), (2, "p", 1_700_000_000_000, "x" * 250, "ж")]
    spark.createDataFrame(rows, "id bigint, project string, ts bigint, user_message string, assistant_message string").write.parquet(f"{tmp_path}/exchanges.parquet")
    assert sorted(tuple(r) for r in reference.snippet_cards(spark, str(tmp_path)).collect()) == [(1, "p", "1970-01-01", "é ü 漢", ""), (2, "p", "2023-11-14", "x" * 200, "ж")]
