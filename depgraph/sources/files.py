"""Files of source text as a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depgraph.sources.listing import any_of, list_files, reachable, read_files

FILES = "path string, rel_path string, content string"


def _expression(pattern: str) -> bool:
    return len(pattern) > 2 and pattern[0] == pattern[-1] == "/"


def matches(path: Column, pattern: str) -> Column:
    """A pattern between slashes is a regular expression; with * or ? it is a glob; other text may stand anywhere."""
    if _expression(pattern):
        return path.rlike(pattern[1:-1])
    if "*" in pattern or "?" in pattern:
        body = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if not c.isalnum() else c for c in pattern)
        return path.rlike(f"(^|/){body}($|/)")
    return path.contains(pattern)


def _pruned(spark: SparkSession, uri: str, includes: Sequence[str], excludes: Sequence[str], suffix: str) -> DataFrame:
    rel = F.col("rel")
    # what a regular expression matches may match no longer behind a folder, so it is tried on files only
    folders = [matches(rel, x) for x in excludes if not _expression(x)]
    wanted = [rel.endswith(suffix), *any_of([matches(rel, x) for x in includes]), *(~matches(rel, x) for x in excludes)]
    found = read_files(list_files(spark, uri, folders, wanted), uri)
    return found.select(F.concat(F.lit(uri.rstrip("/") + "/"), rel).alias("path"), rel.alias("rel_path"), "content")


def scan(spark: SparkSession, paths: Sequence[str], includes: Sequence[str] = (), excludes: Sequence[str] = (), suffix: str = ".php") -> DataFrame:
    """path, rel_path, content of the files below each directory, and of each path that is a file itself.

    Below directories only files with the suffix count, if any include matches (or there is none) and no exclude
    does, on the path below the directory; files given by themselves always count. Each path counts once; paths
    that don't exist are left out. Where tasks can open the store themselves, folders are listed level by level in tasks and
    excluded ones are never opened; elsewhere Spark lists all of them, and filters on paths reach its list of files. Only
    what counts is read.
    """
    jvm, parts = spark._jvm, []
    for p in paths:
        place = jvm.org.apache.hadoop.fs.Path(p)
        fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(place):
            continue
        status = fs.getFileStatus(place)
        read = spark.read.option("wholetext", True)
        path = F.col("_metadata.file_path")
        if status.isFile():
            parts.append(read.text(p).select(path.alias("path"), F.lit(place.getName()).alias("rel_path"), F.col("value").alias("content")))
            continue
        uri = status.getPath().toString()
        if reachable(uri):
            parts.append(_pruned(spark, uri, includes, excludes, suffix))
            continue
        root = status.getPath().toUri().getPath().rstrip("/") + "/"
        rel = F.substring_index(path, root, -1)
        found = read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(p).select(path.alias("path"), rel.alias("rel_path"), F.col("value").alias("content"))
        if includes:
            found = found.where(reduce(Column.__or__, [matches(F.col("rel_path"), x) for x in includes]))
        for x in excludes:
            found = found.where(~matches(F.col("rel_path"), x))
        parts.append(found)
    if not parts:
        return spark.createDataFrame([], FILES)
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["path"])
