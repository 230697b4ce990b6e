"""Append-only JSONL transcripts as a data source, batch and stream.

Rows: ``source_path, generation, chunk, line, byte_start, raw``.  A file is read in chunks of at most ``SPLIT`` bytes, small
files share a task up to as many bytes, so neither a huge file nor a million small ones set the number of tasks.  ``line`` counts
the physical lines of the chunk, from 1, blank ones included though they give no row.  Each chunk ends with a row whose
``raw`` is null and whose ``line`` is the chunk's number of lines; ``placed`` adds them up to numbers in the file.  Only
whole lines are read: what stands behind the last line feed waits.

The stream's offset holds, per file, its generation, the bytes read and a hash of the last 4,096 of them.
A file that has become shorter or whose tail has changed was rewritten: it gets the next generation and
is read from its start.  Planning costs a directory walk and one short read per file.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "source_path string, generation bigint, chunk bigint, line bigint, byte_start bigint, raw string"
TAIL, STEP, SPLIT = 4096, 1 << 16, 64 << 20
OLD = re.compile(r"\.gen-[0-9]+\.jsonl$")


def walk(root: str) -> list[tuple[str, int]]:
    """(path below ``root``, size) of all JSONL files, sorted; links are followed, each folder once."""
    out: list[tuple[str, int]] = []
    seen: set[tuple[int, int]] = set()

    def visit(folder: str) -> None:
        try:
            s = os.stat(folder)
            if (s.st_dev, s.st_ino) in seen:
                return
            seen.add((s.st_dev, s.st_ino))
            entries = list(os.scandir(folder))
        except OSError:
            return
        for e in entries:
            try:
                if e.is_dir():
                    visit(e.path)
                elif e.name.endswith(".jsonl") and not OLD.search(e.name) and e.is_file():
                    out.append((os.path.relpath(e.path, root), e.stat().st_size))
            except OSError:
                continue

    visit(root)
    return sorted(out)


def is_folder(path: str) -> bool:
    return os.path.isdir(path)


def unreadable(root: str) -> list[str]:
    """Source files that can't be opened now."""
    return [p for p, _ in walk(root) if not os.access(os.path.join(root, p), os.R_OK)]


def whole_lines(path: str, size: int) -> int:
    """Offset behind the last line feed before ``size``; searched backwards."""
    with open(path, "rb") as f:
        end = size
        while end > 0:
            start = max(0, end - STEP)
            f.seek(start)
            k = f.read(end - start).rfind(b"\n")
            if k >= 0:
                return start + k + 1
            end = start
    return 0


def tail_hash(path: str, end: int) -> str:
    with open(path, "rb") as f:
        f.seek(max(0, end - TAIL))
        return hashlib.blake2b(f.read(min(TAIL, end)), digest_size=8).hexdigest()


@dataclass
class Chunk:
    """Bytes of a file; the lines that begin in them belong to it.  ``inside``: the first byte may be within a line."""

    root: str
    path: str
    generation: int
    start: int
    stop: int
    inside: bool = False


@dataclass
class Task(InputPartition):
    chunks: list[Chunk]


def tasks(found: list[Chunk], least: int = 16) -> list[Task]:
    """Chunks of whole files cut to ``SPLIT`` bytes and dealt to tasks of as many, at least ``least`` tasks where there is enough."""
    parts = [Chunk(c.root, c.path, c.generation, a, min(a + SPLIT, c.stop), a > c.start) for c in found for a in range(c.start, c.stop, SPLIT)]
    size = min(SPLIT, max(1 << 16, sum(c.stop - c.start for c in parts) // least))
    out: list[list[Chunk]] = []
    room = 0
    for c in sorted(parts, key=lambda c: c.start - c.stop):
        if c.stop - c.start > room:
            out.append([])
            room = size
        out[-1].append(c)
        room -= c.stop - c.start
    return [Task(x) for x in out]


def placed(rows: DataFrame) -> DataFrame:
    """Rows with ``line`` counted within all chunks of the file that were read together, end rows included."""
    key = ["source_path", "generation"]
    w = Window.partitionBy(*key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.where("raw is null").select(*key, "chunk", F.coalesce(F.sum("line").over(w), F.lit(0)).alias("base"))
    return rows.join(bases, [*key, "chunk"]).withColumn("line", F.col("line") + F.col("base")).drop("base")


ARROW = pa.schema([("source_path", pa.string()), ("generation", pa.int64()), ("chunk", pa.int64()), ("line", pa.int64()), ("byte_start", pa.int64()), ("raw", pa.string())])


def batches_of(task: Task, at_once: int = 2000) -> Iterator[pa.RecordBatch]:
    """The rows of a task's chunks in Arrow batches of bounded size."""
    rows: list[tuple] = []
    size = 0
    for c in task.chunks:
        for r in rows_of(c):
            rows.append(r)
            size += len(r[5] or "")
            if len(rows) >= at_once or size >= 8_000_000:
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)
                rows, size = [], 0
    if rows:
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


def rows_of(c: Chunk) -> Iterator[tuple]:
    """Rows of one chunk; bytes that are no UTF-8 make a bad line, whose text can't be JSON."""
    n, at = 0, c.start
    with open(os.path.join(c.root, c.path), "rb") as f:
        if c.inside:  # the line that the byte before belongs to is the neighbour's
            f.seek(c.start - 1)
            at += len(f.readline()) - 1
        f.seek(at)
        while at < c.stop:
            line = f.readline()
            if not line.endswith(b"\n"):
                raise OSError(f"{c.path} is shorter than {c.stop} bytes")
            n += 1
            try:
                text = line.decode("utf-8")
            except UnicodeDecodeError:
                text = "\x00"
            if text.strip():
                yield c.path, c.generation, c.start, n, at, text.strip()
            at += len(line)
    yield c.path, c.generation, c.start, n, at, None


class Batch(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def partitions(self) -> list[Task]:
        return tasks([Chunk(self.root, p, 0, 0, whole_lines(os.path.join(self.root, p), n)) for p, n in walk(self.root)]) or [Task([])]

    def read(self, partition: Task) -> Iterator[pa.RecordBatch]:
        return batches_of(partition)


class Stream(DataSourceStreamReader):
    def __init__(self, root: str) -> None:
        self.root = root
        self.known: dict = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        out = dict(self.known)
        for path, size in walk(self.root):
            full = os.path.join(self.root, path)
            gen, read, tail = out.get(path, (0, 0, ""))
            try:
                if size < read or (read and tail_hash(full, read) != tail):
                    gen, read = gen + 1, 0
                stop = max(read, whole_lines(full, size))
                out[path] = [gen, stop, tail_hash(full, stop)]
            except OSError:
                continue  # an unreadable file doesn't stop the others
        self.known = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Task]:
        self.known = dict(end)
        out = []
        for path, (gen, stop, _) in end.items():
            old, read, _ = start.get(path, (gen, 0, ""))
            first = read if old == gen else 0
            if stop > first:
                out.append(Chunk(self.root, path, gen, first, stop))
        return tasks(out)

    def read(self, partition: Task) -> Iterator[pa.RecordBatch]:
        return batches_of(partition)

    def commit(self, end: dict) -> None:
        self.known = dict(end)


class JsonLines(DataSource):
    """``spark.dataSource.register(JsonLines)``; then format ``json_lines`` with the option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "json_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Batch:
        return Batch(self.options["path"])

    def streamReader(self, schema) -> Stream:  # noqa: N802
        return Stream(self.options["path"])
