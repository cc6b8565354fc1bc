"""Session helpers: test sessions, table access and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

def local_session(app: str = "corrobora", cores: str | None = None, partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own session."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", os.environ.get("CORROBORA_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; only a local master may fall back to a folder of its own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if sc.master == "local" or sc.master.startswith("local["):
        if sc.applicationId not in _own_folders:
            _own_folders[sc.applicationId] = tempfile.mkdtemp(prefix="corrobora-checkpoint-")
            atexit.register(shutil.rmtree, _own_folders[sc.applicationId], ignore_errors=True)
        return _own_folders[sc.applicationId]
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


_own_folders: dict[str, str] = {}

def cut(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """df with its lineage cut: written as a table to the shared checkpoint folder, so a lost executor loses nothing.

    instead_of: the table of an earlier round that nothing reads any more; its files are deleted.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corrobora_path = path
    if instead_of is not None:
        drop_cut(instead_of)
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table made by cut()."""
    path = getattr(df, "_corrobora_path", None)
    if path:
        jvm = df.sparkSession._jvm
        jvm.org.apache.hadoop.fs.Path(path).getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jvm.org.apache.hadoop.fs.Path(path), True)
