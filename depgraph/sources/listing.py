"""Folders listed level by level in tasks: what is excluded is never opened, and neither paths nor texts pass the driver."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depgraph.tables import has_rows, stored

ENTRIES = "rel string, folder boolean, size long"
_ENTRIES = pa.schema([("rel", pa.string()), ("folder", pa.bool_()), ("size", pa.int64())])
#: Bytes of files that a task reads, and folders that it lists, at about.
READ, FOLDERS = 64 << 20, 64


def reachable(uri: str) -> bool:
    """Whether tasks can open the store by themselves."""
    try:
        pafs.FileSystem.from_uri(uri)
    except (OSError, ValueError, ImportError, pa.ArrowException):
        return False
    return True


def _list(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        base = base.rstrip("/")
        for batch in batches:
            for rel in batch.column(0).to_pylist():
                found = fs.get_file_info(pafs.FileSelector(f"{base}/{rel}" if rel else base, allow_not_found=True))
                names = [f for f in found if not f.base_name.startswith(".")]
                at = lambda f: f"{rel}/{f.base_name}" if rel else f.base_name  # noqa: E731, B023
                yield pa.RecordBatch.from_pydict({"rel": [at(f) for f in names], "folder": [f.type == pafs.FileType.Directory for f in names], "size": [f.size or 0 for f in names]}, _ENTRIES)

    return run


def list_files(spark: SparkSession, root: str, pruned: Sequence[Column] = (), wanted: Sequence[Column] = ()) -> DataFrame:
    """rel (the path below ``root``), size of the files below it.

    pruned: conditions on rel under which a folder isn't opened; wanted: conditions that a file must meet. Hidden names (with a dot
    in front) are left out. Each level is one job over its folders.
    """
    folders, files = spark.createDataFrame([("",)], "rel string"), None
    while True:
        found = stored(folders.mapInArrow(_list(root), ENTRIES), "entries")
        own = found.where(~F.col("folder"))
        for w in wanted:
            own = own.where(w)
        files = own.select("rel", "size") if files is None else files.unionByName(own.select("rel", "size"))
        folders = found.where("folder").select("rel")
        for p in pruned:
            folders = folders.where(~p)
        if not has_rows(folders):
            return files
        folders = folders.repartition(max(1, -(-folders.count() // FOLDERS)))


def _read(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        base = base.rstrip("/")
        for batch in batches:
            for rel in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{base}/{rel}") as f:
                    text = f.read().decode("utf-8", "replace")
                yield pa.RecordBatch.from_pydict({"rel": [rel], "content": [text]})

    return run


def read_files(files: DataFrame, root: str) -> DataFrame:
    """rel, content of files (rel, size), dealt out by their sizes."""
    total = files.agg(F.sum("size")).first()[0] or 0
    return files.select("rel").repartition(max(1, -(-total // READ))).mapInArrow(_read(root), "rel string, content string")


def write_files(texts: DataFrame, root: str) -> int:
    """Write a file for each row (rel, content) below ``root``, each by the task that holds it; how many there were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for rel, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = f"{base.rstrip('/')}/{rel}"
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(path) as f:
                    f.write((content or "").encode())
            yield pa.RecordBatch.from_pydict({"n": [len(batch)]}, pa.schema([("n", pa.int64())]))

    return texts.select("rel", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def any_of(conditions: Sequence[Column]) -> list[Column]:
    return [reduce(Column.__or__, conditions)] if conditions else []
