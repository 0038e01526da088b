"""Session helpers: local session for tests, shared scratch folder, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def local_session(cores: str = "8", app: str = "duelstats") -> SparkSession:
    """Session for tests and the bench; on a cluster the job gets its session from the outside."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset (tests) a local folder is made.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current is not None:
        return os.path.dirname(current.rstrip("/"))
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    made = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    sc.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Tables written inside give back the disk of their shuffles at once instead of when the driver's heap is collected."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts lineage, survives the loss of executors, and tells Catalyst the real size, so that joins with small results
    are broadcast and joins with large ones are not.
    """
    path = scratch_path(df.sparkSession, "cut")
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def empty(spark: SparkSession, schema: str | StructType) -> DataFrame:
    """A table without rows; made of Python rows it would start Python workers."""
    return spark.range(0).select(F.from_json(F.lit("{}"), schema).alias("r")).select("r.*")


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The table below a path, None where nothing was written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def release(written: DataFrame) -> None:
    """Remove a table that ``cut`` or ``land`` wrote and that nothing reads any more."""
    for folder in {os.path.dirname(f) for f in written.inputFiles()}:
        remove_folder(folder)


def remove_folder(path: str) -> None:
    """Remove a folder of shared storage that no reader is led to any more; one that is gone already is fine."""
    from pyarrow.fs import FileSystem, FileType

    fs, folder = FileSystem.from_uri(path)
    if fs.get_file_info(folder).type != FileType.NotFound:
        fs.delete_dir(folder)
