"""Operator 6, sharding: size-tiered compaction under a versioned manifest (DataFrame functions only).

A store is a folder: ``data/<id>/*.parquet`` are immutable shards, ``manifest/v<n>.json`` lists the shards of a
version. Readers take the newest manifest; writers add files that no manifest names yet, and then commit the next
manifest by one rename that fails if another writer was first (HDFS and local file systems rename so; on an object
store without such a rename, let one writer commit at a time). So an interrupted job leaves a store as it was.
The driver holds one line a shard, never rows.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def version(self) -> int:
        """The newest version, 0 if there is none yet."""
        if not self._fs.exists(self._path("manifest")):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("manifest"))]
        return max([int(x[1:-5]) for x in names if x.startswith("v") and x.endswith(".json")], default=0)

    def manifest(self, version: int | None = None) -> dict:
        """version, schema (DDL) and shards: file, rows, bytes, tier."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        if not self._fs.exists(self._path(f"manifest/v{version:08d}.json")):
            raise FileNotFoundError(f"{self.path} has no version {version}, or vacuum removed it")
        stream = self._fs.open(self._path(f"manifest/v{version:08d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, manifest: dict) -> None:
        """Make ``manifest`` the version after its own; an error if that version exists already."""
        version = manifest["version"] + 1
        hidden = self._path(f"manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(hidden, False)
        try:
            out.write(bytearray(json.dumps(manifest | {"version": version}).encode()))
        finally:
            out.close()
        options = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark._jsc.hadoopConfiguration()).rename(hidden, self._path(f"manifest/v{version:08d}.json"), options)

    def _change(self, shards) -> int:
        """Commit the newest version as ``shards`` (manifest -> its new parts) changes it. If another writer was first, the
        change is made once more on that writer's version; what was written stays, so nothing is written again."""
        while True:
            before = self.manifest()
            try:
                self.commit(before | shards(before))
                return before["version"] + 1
            except Exception:
                if self.version() <= before["version"]:
                    raise

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        found = self.manifest(version)
        if not found["schema"]:
            raise FileNotFoundError(f"{self.path} has no version yet")
        if not found["shards"]:
            return self.spark.createDataFrame([], found["schema"])
        return self.spark.read.schema(found["schema"]).parquet(*(f"{self.path}/data/{s['file']}" for s in found["shards"]))

    def _listed(self, name: str, smallest: int, fanout: int) -> list[dict]:
        """The shards written under data/<name>, with rows and bytes."""
        there = self._path(f"data/{name}")
        files = [s for s in self._fs.globStatus(self._jvm.org.apache.hadoop.fs.Path(there, "{*.parquet,*/*.parquet}"))]
        if not files:
            return []
        counted = self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.path}/data/{name}").groupBy(F.col("_metadata.file_path").alias("f")).count().collect()
        rows = {f.rsplit(f"/data/{name}/", 1)[1]: n for f, n in counted}
        base = there.toUri().getPath()
        found = {s.getPath().toUri().getPath()[len(base) + 1 :]: s.getLen() for s in files}
        return [{"file": f"{name}/{f}", "bytes": n, "rows": rows.get(f, 0), "tier": tier(n, smallest, fanout)} for f, n in sorted(found.items())]

    def append(self, rows: DataFrame, arrival: str, smallest: int = 1 << 20, fanout: int = 4) -> int:
        """Add rows as small shards, one or more for each value of the column ``arrival`` and task; returns the version.

        Each arrival's rows stay together, so nothing is shuffled; null is an arrival of its own. Rows are kept as they
        are, equal ones and those with nulls too, under any column names; an empty table adds a version without shards.
        """
        schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema)

        def fits(manifest: dict) -> None:
            if manifest["schema"] not in (None, schema):
                raise ValueError("the rows don't have the columns of the store")

        fits(self.manifest())
        name = uuid.uuid4().hex
        column, taken = "arrival", {c.lower() for c in rows.columns}
        while column in taken:
            column += "_"
        quoted = "`" + arrival.replace("`", "``") + "`"
        rows.withColumn(column, F.xxhash64(F.col(quoted))).write.partitionBy(column).option("compression", "zstd").parquet(f"{self.path}/data/{name}")
        new = self._listed(name, smallest, fanout)

        def added(before: dict) -> dict:
            fits(before)
            return {"schema": schema, "shards": before["shards"] + new}

        return self._change(added)

    def compact(self, target: int = 128 << 20, smallest: int = 1 << 20, fanout: int = 4) -> int:
        """Merge each tier of ``fanout`` or more shards below the target size into files of about that size.

        A tier holds the shards whose sizes differ by less than ``fanout`` times. Spark's scan packs a tier's files
        into tasks of the target size, and each task writes one file: rows are not shuffled, and no file is cut.
        Goes on while a tier has enough shards, as what one merge leaves over may fill the next tier. Shards of
        older versions stay until ``vacuum``. Returns the version.
        """
        spark = self.spark
        keys = {"spark.sql.files.maxPartitionBytes": str(target), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
        while True:
            before = self.manifest()
            tiers: dict[int, list[dict]] = {}
            for s in before["shards"]:
                if s["bytes"] * 2 <= target:
                    tiers.setdefault(s["tier"], []).append(s)
            tiers = {k: v for k, v in tiers.items() if len(v) >= fanout}
            if not tiers:
                return before["version"]
            made, merged = [], set()
            was = {k: spark.conf.get(k, None) for k in keys}
            for k, v in keys.items():
                spark.conf.set(k, v)
            try:
                for shards in tiers.values():
                    name = uuid.uuid4().hex
                    files = [f"{self.path}/data/{s['file']}" for s in shards]
                    spark.read.schema(before["schema"]).parquet(*files).write.option("compression", "zstd").parquet(f"{self.path}/data/{name}")
                    new = self._listed(name, smallest, fanout)
                    if sum(s["rows"] for s in new) != sum(s["rows"] for s in shards):
                        raise RuntimeError("a merge did not keep all rows")
                    if len(new) < len(shards):
                        made += new
                        merged |= {s["file"] for s in shards}
            finally:
                for k, v in was.items():
                    spark.conf.unset(k) if v is None else spark.conf.set(k, v)
            if not merged:
                return before["version"]

            def replaced(now: dict) -> dict:
                """Rows that another writer merged meanwhile must not come twice."""
                if not merged <= {s["file"] for s in now["shards"]}:
                    raise RuntimeError("another writer has merged these shards")
                return {"shards": [s for s in now["shards"] if s["file"] not in merged] + made}  # noqa: B023

            self._change(replaced)

    def vacuum(self, grace: float = 7 * 86_400) -> None:
        """Remove all versions but the newest, and the data that only they name.

        Data that no version names may belong to a writer that hasn't committed yet, so it goes only when it is older
        than ``grace`` seconds. A reader of an earlier version, or a merge of its shards, fails from then on.
        """
        newest = self.version()
        folders = lambda version: {s["file"].split("/")[0] for s in self.manifest(version)["shards"]}
        kept = folders(newest)
        there = self._path("manifest")
        names = [s.getPath().getName() for s in self._fs.listStatus(there)] if newest else []
        older = sorted(int(x[1:-5]) for x in names if x.startswith("v") and x.endswith(".json") and int(x[1:-5]) < newest)
        known = set().union(*(folders(v) for v in older))
        for v in older:
            self._fs.delete(self._path(f"manifest/v{v:08d}.json"), False)
        before = (time.time() - grace) * 1000
        there = self._path("data")
        for folder in self._fs.listStatus(there) if self._fs.exists(there) else []:
            name = folder.getPath().getName()
            if name not in kept and (name in known or folder.getModificationTime() < before):
                self._fs.delete(folder.getPath(), True)


def tier(size: int, smallest: int, fanout: int) -> int:
    """0 up to the smallest size, then one more each time the size grows ``fanout`` times."""
    return max(0, math.ceil(math.log(max(size, 1) / smallest, fanout)))
