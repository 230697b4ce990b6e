"""Incremental ingestion: lines are appended once; of a file that grows only the last, open exchange is built anew.

A sync is one run of a stream over a source folder.  Its state is tables below ``root``, each written per
batch into a folder of its own, so that a batch that is run again overwrites what it wrote before:

``lines``      raw lines with their numbers in the file (append-only, the truth);
``exchanges``  the exchanges that the batch built;
``touched``    its files: generation, lines so far, facts of the file, where to resume, from which line on it built anew;
``postings``   terms of these exchanges, as ``operators.index`` reads them;
``commits``    one row, written last: a batch without it isn't visible.

An exchange is current if no later batch built its file anew from its line or an earlier one.  A batch resumes at the
last exchange and reads the committed lines from there on only (``from_batch`` prunes the folders).  It reads a file from its
start where the new lines change what is known of the whole file (session, directory, sidechain, or provider B's signal
and agent, which decide on borders), where the source was rewritten, and where it opted out: then all goes.  So any
chunking of appends gives what one run over the whole files gives.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from threading import Condition, Thread

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlog.functions.text import archive_name
from braidlog.operators import exchanges as ex
from braidlog.operators import providers as pv
from braidlog.operators import vectors
from braidlog.operators.index import POSTINGS, TextIndex, postings_of
from braidlog.sources import jsonl
from braidlog.sources.jsonl import JsonLines

INDEX_VERSION = "1"
LINES = "archive_path string, source_path string, generation bigint, line bigint, byte_start bigint, raw string, batch bigint"
#: What is known of a file; the provider merges it with what new lines say.
META = "session_id string, cwd string, is_sidechain boolean, sidechain_known boolean, agent_path string, signal int, header boolean"
TOUCHED = f"archive_path string, source_path string, generation bigint, n_lines bigint, {META}, skipped boolean, bad_lines bigint, oversize bigint, reparse_line bigint, reparse_batch bigint, first_batch bigint, from_line bigint, batch bigint"
EXCHANGES = "id bigint, archive_path string, line_start bigint, line_end bigint, session_id string, project string, harness string, is_sidechain boolean, ts bigint, user_message string, assistant_message string, tool_names array<string>, batch bigint"
VECTORS = "id bigint, embedding array<float>, run bigint"
COMMITS = "batch bigint, files bigint, new_exchanges bigint, last_id bigint, bad_lines bigint, oversize bigint"
FACTS = "key string, value string, at bigint"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


@dataclass(frozen=True)
class Provider:
    """A transcript format: line facts, what they say of the file, and how that adds up over appended parts."""

    harness: str
    meta: Callable[[DataFrame], DataFrame]
    facts: Callable[[DataFrame, DataFrame], DataFrame]
    #: (column, earlier, new) -> merged, for each column of ``META``
    merged: Callable[[str, Callable[[str], Column], Callable[[str], Column]], Column]


def _merged_a(c: str, old: Callable[[str], Column], new: Callable[[str], Column]) -> Column:
    if c == "is_sidechain":
        return F.when(F.coalesce(old("sidechain_known"), F.lit(False)), old(c)).otherwise(F.coalesce(old(c), F.lit(False)) | F.coalesce(new(c), F.lit(False)))
    if c == "sidechain_known":
        return F.coalesce(old(c), F.lit(False)) | F.coalesce(new(c), F.lit(False))
    return F.coalesce(old(c), new(c))


def _merged_b(c: str, old: Callable[[str], Column], new: Callable[[str], Column]) -> Column:
    if c == "signal":
        return F.greatest(F.coalesce(old(c), F.lit(0)), F.coalesce(new(c), F.lit(0)))
    return F.when(F.coalesce(old("header"), F.lit(False)), old(c)).otherwise(F.coalesce(new(c), old(c)))


PROVIDERS: dict[str, Provider] = {
    "a": Provider("claude", lambda parsed: pv.file_meta_a(parsed), lambda parsed, _: pv.facts_a(parsed, items=False), _merged_a),
    "b": Provider("codex", lambda parsed: pv.meta_b(parsed).withColumn("sidechain_known", F.col("header")), lambda parsed, meta: pv.facts_b(parsed, meta, items=False), _merged_b),
}


class Ingest:
    """One source folder of one kind, read by a provider, and the tables built from it.

    ``marker``: a user message that holds it opts its whole file out, for good; choose what nobody quotes by chance.
    """

    def __init__(self, spark: SparkSession, source: str, root: str, kind: str, provider: str, marker: str, id_floor: Callable[[], int] = lambda: 0, stem: bool = True) -> None:
        if provider not in PROVIDERS:
            raise ValueError(f"unknown provider {provider!r}: {sorted(PROVIDERS)}")
        self.spark, self.source, self.root, self.kind, self.marker, self.id_floor, self.stem = spark, source, root, kind, marker, id_floor, stem
        self.provider = PROVIDERS[provider]
        spark.dataSource.register(JsonLines)

    # ---- tables

    def _path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _table(self, name: str, schema: str) -> DataFrame:
        """A table as far as it is there; reading makes no folders."""
        fs, p = self._path(name)
        if not fs.exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}")

    def _committed(self, name: str, schema: str) -> DataFrame:
        return self._table(name, schema).join(self._table("commits", COMMITS).select("batch"), "batch", "left_semi")

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")

    def _newest(self) -> DataFrame:
        """Each source's newest row of ``touched``."""
        rest = [c for c in _names(TOUCHED) if c != "source_path"]
        return self._committed("touched", TOUCHED).groupBy("source_path").agg(F.max_by(F.struct(*rest), "batch").alias("t")).select("source_path", "t.*")

    def files(self) -> DataFrame:
        return self._newest()

    def skipped(self) -> DataFrame:
        """Archive paths of files that opted out."""
        return self.files().where("skipped").select("archive_path")

    def lines(self) -> DataFrame:
        return self._committed("lines", LINES)

    def _current(self, rows: DataFrame) -> DataFrame:
        """Rows of exchanges (archive_path, line_start, batch) that no later batch built anew, of current generations."""
        touched = self._committed("touched", TOUCHED)
        anew = touched.groupBy("archive_path").agg(F.collect_list(F.struct("batch", "from_line")).alias("anew"))
        now = self._newest().where("not skipped").select("archive_path").join(anew, "archive_path")
        kept = rows.join(now, "archive_path")
        return kept.where(F.forall("anew", lambda x: (x["batch"] <= F.col("batch")) | (x["from_line"] > F.col("line_start")))).drop("anew")

    def exchanges(self) -> DataFrame:
        """All current exchanges."""
        return self._current(self._committed("exchanges", EXCHANGES)).drop("batch")

    def text_index(self) -> TextIndex:
        """The postings of all current exchanges, as an index to search in."""
        live = self._current(self._committed("exchanges", EXCHANGES).select("id", "archive_path", "line_start", "batch")).select("id")
        rows = self._committed("postings", f"{POSTINGS}, batch bigint").drop("batch").join(live, "id", "left_semi")
        total, avgdl = rows.where("term = ''").agg(F.count("*"), F.coalesce(F.avg("dl"), F.lit(0.0))).first()
        rows = rows.where("term <> ''")
        return TextIndex(rows, rows.groupBy("term").agg(F.count("*").alias("df")), total, avgdl, self.stem)

    # ---- key-value facts

    def facts(self) -> dict[str, str]:
        """The newest value of each key (a handful)."""
        got = self._table("meta", FACTS).groupBy("key").agg(F.max_by("value", "at").alias("value")).collect()
        return {r[0]: r[1] for r in got if r[1] is not None}

    def put(self, key: str, value: str | None) -> None:
        self.put_all({key: value})

    def put_all(self, values: dict[str, str | None]) -> None:
        """Newer values of some keys, in one small file."""
        at = time.time_ns()
        self.spark.createDataFrame([(k, v, at) for k, v in values.items()], FACTS).coalesce(1).write.mode("append").parquet(f"{self.root}/meta")

    # ---- one batch

    def last_id(self) -> int:
        return self._table("commits", COMMITS).agg(F.coalesce(F.max("last_id"), F.lit(0))).first()[0]

    def _run_batch(self, chunk: DataFrame, batch: int) -> None:
        # the source is read once; all else works on what was read
        self._write(chunk, "read", batch)
        chunk = self.spark.read.schema(jsonl.SCHEMA).parquet(f"{self.root}/read/batch={batch}")
        if chunk.isEmpty():
            return
        chunk = jsonl.placed(chunk)
        known = [c for c in _names(TOUCHED) if c not in ("source_path", "batch")]
        before = self._newest().select("source_path", *[F.col(c).alias(f"o_{c}") for c in known])
        chunk = chunk.withColumn("archive_path", archive_name(F.lit(self.kind), F.col("source_path"), F.col("generation")))
        placed = chunk.join(before, "source_path", "left").withColumn("same", F.coalesce(F.col("o_generation") == F.col("generation"), F.lit(False)))
        placed = placed.withColumn("line", F.col("line") + F.when(F.col("same"), F.col("o_n_lines")).otherwise(0))
        self._write(placed.where("raw is not null").select("archive_path", "source_path", "generation", "line", "byte_start", "raw"), "lines", batch)
        mine = self.spark.read.schema(LINES).option("basePath", f"{self.root}/lines").parquet(f"{self.root}/lines/batch={batch}")

        # what is known of each file now, and from where it has to be built
        said = self.provider.meta(pv.parsed(mine.select("archive_path", "line", "raw")))
        about = ["archive_path", "source_path", "generation", "same", *[f"o_{c}" for c in known if c != "archive_path"]]
        ends = placed.where("raw is null").groupBy(*about).agg(F.max("line").alias("n_lines"))
        both = ends.join(said.select("archive_path", *[F.col(c).alias(f"n_{c}") for c in _names(META)]), "archive_path", "left")
        old = lambda c: F.when(F.col("same"), F.col(f"o_{c}"))
        both = both.withColumns({c: self.provider.merged(c, old, lambda c: F.col(f"n_{c}")) for c in _names(META)})
        changed = F.lit(False)
        for c in ("session_id", "cwd", "is_sidechain", "agent_path", "signal"):
            changed = changed | ~F.col(c).eqNullSafe(F.col(f"o_{c}"))
        out = F.coalesce("o_skipped", F.lit(False))
        restart = ~F.col("same") | changed | F.col("o_reparse_line").isNull()
        state = both.withColumns({
            "out": out,
            "from_line": F.when(restart, F.lit(0)).otherwise(F.col("o_reparse_line")).cast("long"),
            "first_batch": F.when(F.col("same"), F.col("o_first_batch")).otherwise(batch).cast("long"),
        }).withColumn("need", F.when(restart, F.col("first_batch")).otherwise(F.col("o_reparse_batch")))
        keep = ["archive_path", "source_path", "generation", "n_lines", *_names(META), "out", "from_line", "first_batch", "need"]
        self._write(state.select(*keep), "plan", batch)
        state = self.spark.read.parquet(f"{self.root}/plan/batch={batch}")

        # committed lines from there on; batches before the first needed one aren't opened
        first = state.agg(F.min("need")).first()[0]
        older = self.lines().where((F.col("batch") >= first) & (F.col("batch") < batch))
        every = older.unionByName(mine.select(older.columns)).join(state.select("archive_path", "from_line"), "archive_path").where("line >= from_line")
        facts = self.provider.facts(pv.parsed(every.select("archive_path", "line", "raw")), state)
        folded = ex.folded(facts)
        self._write(folded, "folded", batch)
        folded = self.spark.read.parquet(f"{self.root}/folded/batch={batch}")
        kept = ex.indexed(folded, state, self.provider.harness, self.marker, state.where("out").select("archive_path"))
        after = max(self.last_id(), self.id_floor())
        self._write(ex.numbered(kept, after).select(*[c for c in _names(EXCHANGES) if c != "batch"]), "exchanges", batch)
        made = self.spark.read.schema(EXCHANGES).parquet(f"{self.root}/exchanges/batch={batch}").drop("batch")
        texts = made.select("id", "project", "ts", F.concat_ws("\n", "user_message", "assistant_message").alias("text"))
        order = ["term", "id"]
        self._write(postings_of(texts, self.stem).repartitionByRange(*order).sortWithinPartitions(*order), "postings", batch)

        # the files' new state
        last = folded.groupBy("archive_path").agg(F.max("line_start").alias("last_line"), F.count_if(~ex.fits()).alias("oversize"))
        place = every.join(last.select("archive_path", "last_line"), "archive_path").where("line = last_line").select("archive_path", F.coalesce("batch", F.lit(batch)).alias("last_batch"))
        opted = ex.opted_out(folded, self.marker).withColumn("now_out", F.lit(True))
        bad = facts.groupBy("archive_path").agg(F.count_if("is_bad").alias("bad_lines"))
        touched = state
        for part in (last, place, opted, bad):
            touched = touched.join(part, "archive_path", "left")
        touched = touched.withColumns({
            "skipped": F.col("out") | F.coalesce("now_out", F.lit(False)), "bad_lines": F.coalesce("bad_lines", F.lit(0)), "oversize": F.coalesce("oversize", F.lit(0)),
            "is_sidechain": F.coalesce("is_sidechain", F.lit(False)), "reparse_line": F.col("last_line"), "reparse_batch": F.col("last_batch").cast("long"),
        })
        self._write(touched.select(*[c for c in _names(TOUCHED) if c != "batch"]), "touched", batch)
        n, top = made.agg(F.count("*"), F.max("id")).first()
        seen = self.spark.read.schema(TOUCHED).parquet(f"{self.root}/touched/batch={batch}").agg(F.count("*"), F.sum("bad_lines"), F.sum("oversize")).first()
        row = (seen[0], n, max(after, top or 0), seen[1] or 0, seen[2] or 0)
        self.spark.createDataFrame([row], ", ".join(COMMITS.split(", ")[1:])).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/commits/batch={batch}")
        for name in ("read", "plan", "folded"):  # intermediate tables of this batch
            fs, p = self._path(f"{name}/batch={batch}")
            fs.delete(p, True)

    # ---- runs

    def sync(self, disabled: bool = False) -> dict[str, int]:
        """Read everything new and return the figures of this run; nothing happens while it is disabled."""
        none = {"batches": 0, "files_synced": 0, "new_exchanges": 0, "bad_lines": 0, "oversize": 0, "errors": 0}
        if disabled:
            return none
        done = self._table("commits", COMMITS).agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]
        unreadable = jsonl.unreadable(self.source)  # they are left for later and don't stop the others
        error = f"unreadable: {unreadable[-1]}" if unreadable else None
        stream = self.spark.readStream.format("json_lines").option("path", self.source).load()
        run: Callable[[DataFrame, int], None] = self._run_batch
        try:
            stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        except Exception as e:
            self.put("last_error", str(e)[:500])
            raise
        got = self._table("commits", COMMITS).where(F.col("batch") > done).agg(F.count("*"), *[F.coalesce(F.sum(c), F.lit(0)) for c in ("files", "new_exchanges", "bad_lines", "oversize")]).first()
        if got[0]:
            self.put_all({"last_error": error, "last_sync": datetime.now(UTC).isoformat(), "index_version": INDEX_VERSION})
        elif error or "last_error" in self.facts():
            self.put("last_error", error)
        return dict(zip(none, [*got, len(unreadable)], strict=True))

    def rebuild(self) -> int:
        """Build all exchanges anew from the committed lines, where the engine's version differs from the tables'; returns how many."""
        if self.facts().get("index_version") == INDEX_VERSION:
            return 0
        fs, p = self._path("commits")
        if not fs.exists(p):
            return 0
        batch = self._table("commits", COMMITS).agg(F.max("batch")).first()[0]
        newest = self._newest().where("not skipped")
        lines = self.lines().join(newest.select("archive_path"), "archive_path", "left_semi")
        facts = self.provider.facts(pv.parsed(lines.select("archive_path", "line", "raw")), newest)
        after = max(self.last_id(), self.id_floor())
        kept = ex.numbered(ex.indexed(ex.folded(facts), newest, self.provider.harness, self.marker), after)
        # one more batch of files that are built anew from their first line
        self._write(kept.select(*[c for c in _names(EXCHANGES) if c != "batch"]), "exchanges", batch + (1 << 40))
        made = self.spark.read.schema(EXCHANGES).parquet(f"{self.root}/exchanges/batch={batch + (1 << 40)}").drop("batch")
        texts = made.select("id", "project", "ts", F.concat_ws("\n", "user_message", "assistant_message").alias("text"))
        self._write(postings_of(texts, self.stem).sortWithinPartitions("term", "id"), "postings", batch + (1 << 40))
        self._write(newest.withColumn("from_line", F.lit(0).cast("long")).select(*[c for c in _names(TOUCHED) if c != "batch"]), "touched", batch + (1 << 40))
        n, top = made.agg(F.count("*"), F.max("id")).first()
        self.spark.createDataFrame([(newest.count(), n, max(after, top or 0), 0, 0)], ", ".join(COMMITS.split(", ")[1:])).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/commits/batch={batch + (1 << 40)}")
        self.put("index_version", INDEX_VERSION)
        return n

    def embed(self, embedder: vectors.Embedder | int = 384) -> int:
        """Vectors for all exchanges that have none; returns how many were made.

        A run writes a folder of its own.  ``vectors`` joins them to the exchanges as they are now, so a vector
        whose exchange has been replaced meanwhile is never seen.
        """
        done = self._table("vectors", VECTORS)
        todo = vectors.pending(self.exchanges(), done)
        text = ex.embedding_text(F.col("user_message"), F.col("assistant_message"), F.col("tool_names"))
        run = done.agg(F.coalesce(F.max("run"), F.lit(-1))).first()[0] + 1
        path = f"{self.root}/vectors/run={run}"
        try:
            todo.select("id", vectors.embed(embedder)(text).alias("embedding")).write.mode("overwrite").parquet(path)
        except Exception as e:
            self.put("last_embed_error", str(e)[:500])
            raise
        if "last_embed_error" in self.facts():
            self.put("last_embed_error", None)
        return self.spark.read.parquet(path).count()

    def vectors(self) -> DataFrame:
        """id, embedding, project, ts, is_sidechain of the exchanges that have a vector."""
        return vectors.attach(self._table("vectors", VECTORS).select("id", "embedding").dropDuplicates(["id"]), self.exchanges())


class Library:
    """Several source roots, each a kind with its provider; missing ones are left out, and one that fails doesn't stop the rest."""

    def __init__(self, spark: SparkSession, roots: dict[str, tuple[str, str]], root: str, marker: str) -> None:
        self.roots = roots
        self.parts = {k: Ingest(spark, path, f"{root}/{k}", k, provider, marker, self._last_id) for k, (path, provider) in roots.items()}
        self.failed: dict[str, str] = {}

    def _last_id(self) -> int:
        return max((p.last_id() for p in self.parts.values()), default=0)

    def found(self) -> dict[str, bool]:
        return {k: jsonl.is_folder(path) for k, (path, _) in self.roots.items()}

    def discovered(self) -> list[tuple[str, str, int]]:
        """(kind, path below its root, size) of all source files of all roots, in order of kind and path."""
        return [(k, p, n) for k, there in self.found().items() if there for p, n in jsonl.walk(self.roots[k][0])]

    def sync(self, disabled: bool = False) -> dict[str, int]:
        total: dict[str, int] = {}
        self.failed = {}
        for k, there in self.found().items():
            if not there:
                continue
            try:
                got = self.parts[k].sync(disabled)
            except Exception as e:
                self.failed[k] = str(e)
                got = {"errors": 1}
            for name, n in got.items():
                total[name] = total.get(name, 0) + n
        return total

    def _all(self, rows: Callable[[Ingest], DataFrame]) -> DataFrame:
        out = None
        for p in self.parts.values():
            out = rows(p) if out is None else out.unionByName(rows(p))
        return out

    def exchanges(self) -> DataFrame:
        return self._all(Ingest.exchanges)

    def files(self) -> DataFrame:
        return self._all(Ingest.files)


class Scheduler:
    """Runs a job on request: one at a time, and at most one more waits; whoever waits sees a run begun after the request."""

    def __init__(self, job: Callable[[], object]) -> None:
        self.job, self.lock = job, Condition()
        self.asked = self.begun = self.ended = 0
        self.running = False

    def request(self) -> int:
        """Ask for a run; requests that meet a waiting one share it.  Returns the number to wait for."""
        with self.lock:
            if self.asked <= self.begun:
                self.asked = self.begun + 1
            if not self.running:
                self.running = True
                Thread(target=self._work, daemon=True).start()
            return self.asked

    def wait(self, number: int, seconds: float | None = None) -> bool:
        with self.lock:
            return self.lock.wait_for(lambda: self.ended >= number, seconds)

    def _work(self) -> None:
        while True:
            with self.lock:
                if self.begun >= self.asked:
                    self.running = False
                    return
                self.begun = now = self.asked
            try:
                self.job()
            finally:
                with self.lock:
                    self.ended = now
                    self.lock.notify_all()


def one_shot(spark: SparkSession, source: str, kind: str, provider: str, marker: str) -> DataFrame:
    """Exchanges of whole files, without any state."""
    spark.dataSource.register(JsonLines)
    how = PROVIDERS[provider]
    lines = jsonl.placed(spark.read.format("json_lines").option("path", source).load()).where("raw is not null")
    parsed = pv.parsed(lines.select(archive_name(F.lit(kind), F.col("source_path"), F.lit(0)).alias("archive_path"), "line", "raw"))
    meta = how.meta(parsed)
    return ex.indexed(ex.folded(how.facts(parsed, meta)), meta, how.harness, marker)
