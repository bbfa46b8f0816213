"""Session helpers that hold for a laptop and for a cluster."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lattica")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; an own temporary one only on a local master where none is named."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lattica-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and read it from there.

    The files outlive executors; Spark's cleaner removes them when the frame is
    no longer referenced (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    ensure_checkpoint_dir(df.sparkSession)
    with _shuffles_freed(df.sparkSession):
        # a frame keeps the settings it was made under
        return df.select("*").checkpoint(eager=True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared checkpoint folder and read it from there, so that later readers prune columns and rows."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_freed(spark):
        df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def saved_in_slices(part: Callable[[int], DataFrame], slices: int, name: str) -> DataFrame:
    """The union of ``part(0)`` to ``part(slices - 1)`` as ``saved`` gives it; each is computed and written before the next, so only one slice's shuffle files are on disk at a time."""
    first = part(0)
    spark = first.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for k in range(slices):
        with _shuffles_freed(spark):
            (part(k) if k else first).write.mode("append").parquet(path, compression="zstd")
    return spark.read.schema(first.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove the files of a table that ``saved`` or ``saved_in_slices`` gave and nothing reads any more."""
    spark = table.sparkSession
    context, at = spark.sparkContext, ensure_checkpoint_dir(spark).rstrip("/").rsplit("/", 1)[-1]
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if folder.rsplit("/", 2)[-2] == at:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go when it is written, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
