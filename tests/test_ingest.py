"""Incremental ingestion gives what one run gives, for any chunking; and the rules of both producers."""

import json
import os

import pytest
from braidlog.operators import exchanges as ex
from braidlog.sources import jsonl
from braidlog.streaming.ingest import INDEX_VERSION, Ingest, Library, Scheduler, one_shot


MARK = "<<leave-this-chat-out>>"


def a(kind, content, **more):
    return json.dumps({"type": kind, "timestamp": "2025-01-01T10:00:00Z", "message": {"role": kind, "content": content}, **more})


def b(kind, payload):
    return json.dumps({"timestamp": "2025-01-01T10:00:00Z", "type": kind, "payload": payload})


def said(text, role="assistant"):
    return b("response_item", {"type": "message", "role": role, "content": [{"type": "output_text" if role == "assistant" else "input_text", "text": text}]})


MAIN_A = [
    a("user", "first question", sessionId="s1"), a("assistant", [{"type": "text", "text": "part one"}, {"type": "tool_use", "name": "Bash", "input": {"x": 1}}], cwd="/srv/work/alpha"), "", "{broken",
    a("user", [{"type": "tool_result", "content": "out"}]), a("assistant", [{"type": "text", "text": "part two"}, {"type": "tool_use", "name": "Read", "input": {}}, {"type": "tool_use", "name": "Bash", "input": {}}]),
    a("user", [{"type": "text", "text": "second"}, {"type": "text", "text": "question"}]), a("assistant", [{"type": "tool_use", "name": "SubagentHandback", "input": {"message": "handed back"}}]),
    a("user", "meta", isMeta=True), a("user", "<bash-stdout>x"), a("user", "unanswered"),
]
MAIN_B = [
    b("session_meta", {"id": "s2", "cwd": "/srv/work/beta"}), said("# AGENTS.md instructions", "user"), said("weak start", "user"), said("answer to weak"),
    b("event_msg", {"type": "user_message", "message": "middle start"}), said("answer to middle"), b("session_meta", {"id": "other", "cwd": "/x"}),
    b("event_msg", {"type": "item_completed", "item": {"type": "UserMessage", "content": [{"type": "text", "text": "strong start"}]}}),
    b("response_item", {"type": "function_call", "name": "exec", "arguments": "{}"}), b("response_item", {"type": "local_shell_call", "action": {}}), b("event_msg", {"type": "agent_message", "message": "streamed"}),
    b("event_msg", {"type": "item_completed", "item": {"type": "UserMessage", "content": [{"type": "text", "text": "silent"}]}}),
]
COLUMNS = ["archive_path", "line_start", "line_end", "session_id", "project", "harness", "is_sidechain", "ts", "user_message", "assistant_message", "tool_names"]


def rows(df):
    return sorted([tuple(r) for r in df.select(*COLUMNS).collect()], key=str)


def test_fold_of_provider_a(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("\n".join(MAIN_A) + "\n")
    got = rows(one_shot(spark, str(tmp_path), "k", "a", MARK))
    assert [(r[1], r[2], r[8], r[9], r[10]) for r in got] == [
        (1, 6, "first question", "part one\n\npart two", ["Bash", "Read"]),
        (7, 10, "second\nquestion", "handed back", ["SubagentHandback"]),
    ]
    assert {(r[0], r[3], r[4], r[7]) for r in got} == {("conversation-archive/k/x.jsonl", "s1", "alpha", 1735725600000)}


def test_fold_of_provider_b(spark, tmp_path):
    """The strongest signal of all lines counts, the first header, and streamed text only where no answer is."""
    (tmp_path / "y.jsonl").write_text("\n".join(MAIN_B) + "\n")
    (got,) = rows(one_shot(spark, str(tmp_path), "k", "b", MARK))
    assert got[1:6] == (8, 11, "s2", "beta", "codex") and got[8:] == ("strong start", "streamed", ["exec", "local_shell"])
    weak = [x for x in MAIN_B if "item_completed" not in x and "user_message" not in x]
    (tmp_path / "y.jsonl").write_text("\n".join(weak) + "\n")
    assert [(r[8], r[9]) for r in rows(one_shot(spark, str(tmp_path), "k", "b", MARK))] == [("weak start", "answer to weak\n\nanswer to middle")]


def test_subagent_of_provider_b(spark, tmp_path):
    lines = [b("session_meta", {"id": "p", "cwd": "/w/c", "source": {"subagent": {"thread_spawn": {"agent_path": "/root/x"}}}}), said("no start here", "user"),
             b("response_item", {"type": "agent_message", "recipient": "/root/x", "content": [{"type": "input_text", "text": "task"}]}), said("done")]
    (tmp_path / "z.jsonl").write_text("\n".join(lines) + "\n")
    (got,) = rows(one_shot(spark, str(tmp_path), "k", "b", MARK))
    assert got[6] is True and got[8:10] == ("task", "done")


@pytest.mark.parametrize("provider,lines", [("a", MAIN_A), ("b", MAIN_B)])
@pytest.mark.parametrize("step", ["short", "longest", "whole"])
def test_any_chunking_equals_one_run(spark, tmp_path, provider, lines, step):
    body = ("\n".join(lines) + "\n").encode()
    size = {"short": len(body) // 3 + 1, "longest": max(map(len, lines)) + 1, "whole": len(body)}[step]
    src = tmp_path / "src"
    src.mkdir()
    job = Ingest(spark, str(src), str(tmp_path / "state"), "k", provider, MARK)
    for i in range(0, len(body), size):
        with open(src / "f.jsonl", "ab") as f:
            f.write(body[i : i + size])
        job.sync()
    assert rows(job.exchanges()) == rows(one_shot(spark, str(src), "k", provider, MARK))
    assert job.sync()["batches"] == 0


def test_growth_rewrite_and_opt_out(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    job = Ingest(spark, str(src), str(tmp_path / "state"), "k", "a", MARK)
    (src / "f.jsonl").write_text("\n".join([a("user", "one"), a("assistant", [{"type": "text", "text": "x"}])]) + "\n")
    job.sync()
    first = job.exchanges().first()
    assert job.embed(16) == 1 and job.embed(16) == 0 and [r["id"] for r in job.vectors().collect()] == [first["id"]]
    with open(src / "f.jsonl", "a") as f:
        f.write(a("assistant", [{"type": "text", "text": "y"}], sessionId="late") + "\n" + '{"type": "user", "mess')
    job.sync()
    second = job.exchanges().first()
    assert job.vectors().isEmpty() and job.embed(16) == 1 and job.vectors().count() == 1
    assert second["id"] > first["id"] and second["assistant_message"] == "x\n\ny" and second["session_id"] == "late"
    (src / "f.jsonl").write_text("\n".join([a("user", "other"), a("assistant", [{"type": "text", "text": "z"}])]) + "\n")
    job.sync()
    (third,) = job.exchanges().collect()
    assert third["archive_path"].endswith("f.gen-1.jsonl") and third["user_message"] == "other" and third["id"] > second["id"]
    with open(src / "f.jsonl", "a") as f:
        f.write(a("user", f"please: {MARK}") + "\n")
    job.sync()
    assert job.exchanges().isEmpty() and job.files().first()["skipped"]
    with open(src / "f.jsonl", "a") as f:
        f.write(a("user", "again") + "\n" + a("assistant", [{"type": "text", "text": "no"}]) + "\n")
    job.sync()
    assert job.exchanges().isEmpty() and job.lines().count() >= 5


def test_oversize_is_counted_in_bytes(spark, tmp_path):
    big = "é" * (ex.MOST_BYTES // 2)
    for n, kept in ((0, 1), (1, 0)):
        (tmp_path / "f.jsonl").write_text(a("user", big + "x" * n) + "\n" + a("assistant", [{"type": "text", "text": "ok"}]) + "\n")
        assert one_shot(spark, str(tmp_path), "k", "a", MARK).count() == kept


def test_walk_skips_old_generations_and_loops(tmp_path):
    (tmp_path / "d").mkdir()
    for n in ("a.jsonl", "d/b.jsonl", "d/b.gen-2.jsonl", "d/c.gen-x.jsonl", "e.JSONL", "f.txt"):
        (tmp_path / n).write_text("x\n")
    os.symlink(tmp_path, tmp_path / "d" / "loop")
    assert [p for p, _ in jsonl.walk(str(tmp_path))] == ["a.jsonl", "d/b.jsonl", "d/c.gen-x.jsonl"]


def test_whole_lines(tmp_path):
    f = tmp_path / "x"
    f.write_bytes(b"a\nbb\nccc")
    assert [jsonl.whole_lines(str(f), n) for n in (8, 5, 4, 1, 0)] == [5, 5, 2, 0, 0]


def test_a_growing_file_is_resumed_at_its_last_exchange(spark, tmp_path):
    """Earlier exchanges keep their ids and aren't built again; only the lines from the last one on are read."""
    src = tmp_path / "src"
    src.mkdir()
    job = Ingest(spark, str(src), str(tmp_path / "state"), "k", "a", MARK)

    def turn(q, x):
        return a("user", q, sessionId="s") + "\n" + a("assistant", [{"type": "text", "text": x}]) + "\n"

    (src / "f.jsonl").write_text(turn("one", "x1") + turn("two caching", "x2") + "{bad\n")
    assert job.sync() == {"batches": 1, "files_synced": 1, "new_exchanges": 2, "bad_lines": 1, "oversize": 0, "errors": 0}
    ids = {r["user_message"]: r["id"] for r in job.exchanges().collect()}
    with open(src / "f.jsonl", "a") as f:
        f.write(turn("three", "x3"))
    got = job.sync()
    now = {r["user_message"]: r["id"] for r in job.exchanges().collect()}
    assert got["new_exchanges"] == 2 and now["one"] == ids["one"] and now["two caching"] > ids["two caching"] and set(now) == {"one", "two caching", "three"}
    row = job.files().first()
    assert (row["from_line"], row["reparse_line"], row["reparse_batch"], row["n_lines"]) == (3, 6, 1, 7)
    index = job.text_index()
    assert index.total == 3 and [r["id"] for r in index.best("cache", 5).collect()] == [now["two caching"]]
    assert rows(job.exchanges()) == rows(one_shot(spark, str(src), "k", "a", MARK))
    assert job.sync(disabled=True)["batches"] == 0 and job.rebuild() == 0 and job.facts()["index_version"] == INDEX_VERSION
    job.put("index_version", "0")
    assert job.rebuild() == 3 and rows(job.exchanges()) == rows(one_shot(spark, str(src), "k", "a", MARK)) and min(r["id"] for r in job.exchanges().collect()) > max(now.values())


def test_roots_and_failures(spark, tmp_path):
    """Missing roots are left out, ids are unique over kinds, and what is unreadable or fails is told."""
    for k, lines in (("x", MAIN_A), ("y", MAIN_B)):
        (tmp_path / k).mkdir()
        (tmp_path / k / "f.jsonl").write_text("\n".join(lines) + "\n")
    lib = Library(spark, {"x": (str(tmp_path / "x"), "a"), "y": (str(tmp_path / "y"), "b"), "z": (str(tmp_path / "none"), "a")}, str(tmp_path / "state"), MARK)
    assert lib.found() == {"x": True, "y": True, "z": False} and [d[:2] for d in lib.discovered()] == [("x", "f.jsonl"), ("y", "f.jsonl")]
    assert lib.sync()["files_synced"] == 2 and lib.failed == {}
    ids = [r["id"] for r in lib.exchanges().collect()]
    assert len(ids) == len(set(ids)) == 3 and not lib.files().where("skipped").count()
    lib.parts["y"]._run_batch = lambda *_: 1 / 0
    (tmp_path / "y" / "g.jsonl").write_text(MAIN_B[0] + "\n")
    with open(tmp_path / "x" / "f.jsonl", "a") as f:
        f.write(a("user", "late") + "\n" + a("assistant", [{"type": "text", "text": "z"}]) + "\n")
    got = lib.sync()
    assert got["errors"] == 1 and got["files_synced"] == 1 and set(lib.failed) == {"y"} and lib.exchanges().where("user_message = 'late'").count() == 1
    assert "last_error" in lib.parts["y"].facts() and "last_error" not in lib.parts["x"].facts()
    with pytest.raises(ValueError):
        Ingest(spark, "", "", "k", "unknown", MARK)


def test_requests_are_coalesced():
    import threading

    gate, runs = threading.Semaphore(0), []

    def job():
        runs.append(1)
        gate.acquire()

    s = Scheduler(job)
    first = s.request()
    while not runs:
        pass
    later = {s.request() for _ in range(20)}
    assert len(later) == 1 and not s.wait(first, 0.01)
    gate.release()
    assert s.wait(first, 5) and not s.wait(max(later), 0.05)
    gate.release()
    assert s.wait(max(later), 5) and len(runs) == 2


def test_a_quoted_sentence_is_no_marker(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text(a("user", "what does 'leave this chat out' mean, or leave-this-chat-out?") + "\n" + a("assistant", [{"type": "text", "text": "ok"}]) + "\n")
    assert one_shot(spark, str(tmp_path), "k", "a", MARK).count() == 1


@pytest.mark.parametrize("split", [7, 20, 64, 1000])
def test_files_are_cut_into_chunks_of_lines(tmp_path, monkeypatch, split):
    """Whatever the size of a chunk, each line is read once, with its number and place."""
    monkeypatch.setattr(jsonl, "SPLIT", split)
    bodies = {"a": b"x\n\nlonger line here\n" + b"z" * 50 + b"\nend\n", "b": b"one\n", "c": "é€\nü\n".encode()}
    for n, body in bodies.items():
        (tmp_path / f"{n}.jsonl").write_bytes(body)
    found = [jsonl.Chunk(str(tmp_path), f"{n}.jsonl", 0, 0, len(b)) for n, b in bodies.items()]
    got = [r for t in jsonl.tasks(found) for c in t.chunks for r in jsonl.rows_of(c)]
    for n, body in bodies.items():
        mine = sorted((r for r in got if r[0] == f"{n}.jsonl"), key=lambda r: (r[2], r[5] is None, r[3]))
        base, lines = 0, []
        for r in mine:
            if r[5] is None:
                base += r[3]
            else:
                lines.append((base + r[3], r[4], r[5]))
        want, at = [], 0
        for i, line in enumerate(body.split(b"\n")[:-1], 1):
            if line.strip():
                want.append((i, at, line.decode()))
            at += len(line) + 1
        assert lines == want and base == body.count(b"\n")
