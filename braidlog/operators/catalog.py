"""The registry of files, key-value facts, and health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlog.functions.text import base_path, generation
from braidlog.operators.exchanges import fits

HEAD = 3


def latest(rows: DataFrame, key: str, order: str, *ties: str) -> DataFrame:
    """The newest row per key: an upsert read back.  ``max_by`` keeps a hot key's rows in its map side."""
    rest = [c for c in rows.columns if c != key]
    picked = F.max_by(F.struct(*rest), F.struct(order, *ties))
    return rows.groupBy(key).agg(picked.alias("r")).select(key, "r.*").select(*rows.columns)


def current_generations(files: DataFrame) -> DataFrame:
    """Archives without those that a later generation of the same base path replaced."""
    df = files.withColumns({"base": base_path(F.col("archive_path")), "gen": generation(F.col("archive_path"))})
    return latest(df, "base", "gen", "archive_path").drop("base", "gen")


def changed(found: DataFrame, files: DataFrame) -> DataFrame:
    """Discovered sources (source_path, size) that are new or whose size differs from the registry's offset."""
    known = files.select("source_path", "end_offset")
    return found.join(known, "source_path", "left").where(F.col("end_offset").isNull() | (F.col("end_offset") != F.col("size")))


def unknown(found: DataFrame, files: DataFrame) -> DataFrame:
    """Archives that no row knows by source or by archive path (two anti-joins for an OR)."""
    return found.join(files.select("source_path"), "source_path", "left_anti").join(files.select("archive_path"), "archive_path", "left_anti")


def opted_out(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of archives that opted out in any generation; a semi-join on the path without its generation."""
    out = files.where("skipped").select(base_path(F.col("archive_path")).alias("base")).distinct()
    return rows.withColumn("base", base_path(F.col("archive_path"))).join(out, "base", "left_semi").drop("base")


def reindexed(files: DataFrame) -> DataFrame:
    """Files that a rebuild reads again: with committed bytes, and not opted out."""
    return files.where((F.col("end_offset") > 0) & ~F.col("skipped"))


def get(facts: DataFrame, key: str) -> str | None:
    """The value of a key; null where it is missing or the table can't be read."""
    try:
        row = facts.where(F.col("key") == key).select("value").first()
    except Exception:
        return None
    return row[0] if row else None


def relative_paths(files: DataFrame, root: str) -> DataFrame:
    """Archive paths below ``root`` made relative, unless the relative one exists already."""
    short = files.where(F.col("archive_path").startswith(root)).withColumn("short", F.substring("archive_path", len(root) + 1, 1 << 30))
    taken = files.select(F.col("archive_path").alias("short"))
    return short.join(taken, "short", "left_anti").select("source_path", F.col("short").alias("archive_path"))


def put(facts: DataFrame, new: DataFrame) -> DataFrame:
    """Key-value rows with those of ``new`` put over them."""
    return facts.join(new.select("key"), "key", "left_anti").unionByName(new)


def counts(files: DataFrame, exchanges: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: files, skipped, exchanges, pending."""
    f = files.agg(F.count("*").alias("files"), F.count_if("skipped").alias("skipped"))
    e = exchanges.select("id").join(vectors.select("id", F.lit(1).alias("has")), "id", "left").agg(F.count("*").alias("exchanges"), F.count_if(F.col("has").isNull()).alias("pending"))
    one = F.lit(1).alias("one")
    return f.select("*", one).join(e.select("*", one), "one").drop("one")


def health(counted: DataFrame, facts: dict[str, str], roots: dict[str, bool]) -> DataFrame:
    """name, level (ok, warn, fail), detail of each check."""
    revision = facts.get("revision")
    if revision is None:
        db = ("warn", "not created yet (no sync has run)")
    elif int(revision) > HEAD:
        db = ("fail", f"revision {revision} is newer than this engine (revision {HEAD})")
    elif int(revision) < HEAD:
        db = ("warn", f"revision {revision} of {HEAD}: the next sync migrates")
    else:
        db = ("ok", f"revision {revision}")
    error, sync = facts.get("last_error"), facts.get("last_sync")
    last = ("warn", f"last error: {error}") if error else ("ok", sync) if sync else ("warn", "never")
    found = "; ".join(f"{k} ({'found' if v else 'missing'})" for k, v in sorted(roots.items()))
    source = ("ok" if any(roots.values()) else "fail", found)
    failed = facts.get("last_embed_error")
    waiting = F.concat(F.col("pending").cast("string"), F.lit(" exchange(s) waiting for embedding"))
    detail = F.concat(waiting, F.lit(f"; last error: {failed}")) if failed else F.when(F.col("pending") > 0, waiting).otherwise("none pending")
    level = F.lit("warn") if failed else F.when(F.col("pending") > 0, "warn").otherwise("ok")
    checks = F.array(
        *[F.struct(F.lit(n).alias("name"), F.lit(v[0]).alias("level"), F.lit(v[1]).alias("detail")) for n, v in (("db", db), ("last-sync", last), ("source-roots", source))],
        F.struct(F.lit("embeddings").alias("name"), level.alias("level"), detail.alias("detail")),
    )
    return counted.select(F.explode(checks).alias("c")).select("c.*")


def failing(checks: DataFrame) -> DataFrame:
    return checks.agg(F.bool_or(F.col("level") == "fail").alias("failing"))


def observed(exchanges: DataFrame) -> DataFrame:
    """Figures of a sync, one row."""
    return exchanges.agg(
        F.countDistinct("archive_path").alias("files_synced"), F.count("*").alias("new_exchanges"), F.sum("bad_lines").alias("bad_lines"), F.count_if(~fits()).alias("oversize")
    )
