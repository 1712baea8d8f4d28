"""Intermediate tables in the folder that driver and executors share, for loops that must cut their lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a local session that lacks it gets a temporary folder of its own; elsewhere
    executors would write to disks that others can't read, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and the executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_RECORDERS: list[list[DataFrame]] = []


@contextmanager
def recorded() -> Iterator[list[DataFrame]]:
    """The tables that ``stored`` writes meanwhile, for whoever knows when they may be discarded."""
    made: list[DataFrame] = []
    _RECORDERS.append(made)
    try:
        yield made
    finally:
        _RECORDERS.pop()


_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files, which would else lie there until the driver collects its garbage."""
    before = spark.conf.get(_SWEEP, None)
    spark.conf.set(_SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_SWEEP) if before is None else spark.conf.set(_SWEEP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.stored_at = path
    for held in _RECORDERS:
        held.append(made)
    return made


def settled(df: DataFrame, name: str) -> DataFrame:
    """``stored``, and its shuffle files are gone."""
    with swept(df.sparkSession):
        return stored(df, name)


def numbered(df: DataFrame, *order: str, into: str = "place") -> DataFrame:
    """Add the place of each row in an order, from 1, counted range by range: no task sees more than its own range."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(into, F.monotonically_increasing_id())
    ranged = settled(ranged, "numbered")
    part = F.shiftright(into, 33).alias("_part")
    sizes = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("n"))  # one row a range
    begins = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_begin"))
    within = F.col(into).bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.withColumn("_part", part).join(F.broadcast(begins), "_part").withColumn(into, F.col("_begin") + within + 1).drop("_part", "_begin")


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing will read any more; others are left alone."""
    for t in tables:
        if path := getattr(t, "stored_at", None):
            spark = t.sparkSession
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def has_rows(df: DataFrame) -> bool:
    return bool(df.take(1))
