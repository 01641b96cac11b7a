"""Session helpers: a default session for scripts and tests, and the package on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_shipped: set[str] = set()
_local_dirs: dict[str, str] = {}


def session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings this engine is written for: AQE with skew handling, UTC."""
    builder = (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Let Spark hand this package to Python workers, once per application; its file server does it,
    so no folder needs to be shared."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="plumbline-ship-")) / "plumbline.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, f"{root.name}/{file.relative_to(root).as_posix()}")
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir.  Where the session names none
    (tests), a session on this machine alone gets a folder of its own; a cluster has to name one, as no
    folder of one machine would do."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or _local_dirs.get(sc.applicationId)
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        found = _local_dirs[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        sc.setCheckpointDir(found)
    path = sc._jvm.org.apache.hadoop.fs.Path(found)
    return str(path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path)).rstrip("/")


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write a table to the shared folder and read it back, so that loops keep a short lineage that
    survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/plumbline/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """For costly work a row: rows of fewer partitions than there are cores are dealt over all of them.
    Tables of many files keep their partitions and pay no shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def unnest(df: DataFrame, name: str, entries: Column, *columns: str | Column) -> DataFrame:
    """columns, and a row per entry (none is null) of an array that is costly to work out.  Before explode() Spark
    puts a filter that works the array out once more; before explode_outer() it puts none."""
    return df.select(*columns, F.explode_outer(entries).alias(name)).filter(F.col(name).isNotNull())


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of the code's or a vocabulary's own size.  By way of Arrow it is a local relation: Spark knows
    its size and plans broadcasts for it, instead of shuffling what it is joined with."""
    kind = StructType.fromDDL(schema)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kind)
    types = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    return spark.createDataFrame(pa.table([pa.array(c, types[f.dataType.simpleString()]) for c, f in zip(columns, kind, strict=True)], names=kind.names), kind)
