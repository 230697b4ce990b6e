"""Sessions, checkpoints and parallelism shared by all operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    n = cpus or os.cpu_count() or 4
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName("braidlog")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers of a session whose Python path lacks it; once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(here)
    path = os.path.join(tempfile.mkdtemp(prefix=f"{name}-code-"), f"{name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(here):
            for f in files:
                if f.endswith((".py", ".json")):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, here)))
    sc.addPyFile(path)


def _shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only in a local session without it (tests, a laptop) a local folder."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="braidlog-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


_TABLES: list[tuple[SparkSession, str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{_shared_folder(spark)}/braidlog-{name}-{uuid.uuid4().hex}"
    _TABLES.append((spark, path))
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a compressed table into the shared folder and read it back, without its lineage.

    The files outlive any executor.  They are removed by ``drop_cut`` or when the application ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def drop_cut() -> None:
    """Remove the tables written by ``cut``; frames that still read them fail afterwards."""
    while _TABLES:
        spark, path = _TABLES.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone already
            return


def shuffle_width(spark: SparkSession) -> int:
    """Partitions to use where an operator fixes their number itself."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
