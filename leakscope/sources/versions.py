"""Tables of Parquet folders whose content a small manifest names.

Data folders are written under new names and never changed. A version is one manifest file, put in place by a rename that fails if
another writer was first, so readers see the table before or after a change and nothing between. Every change carries the name of
its run; a run that is in the table's past changes nothing when it is repeated.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "_bucket"


class Folder:
    """Small files in a folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        plain = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = plain.getFileSystem(self._conf)
        self.path = self._fs.makeQualified(plain).toString()

    def _path(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        if not self._fs.exists(self._path()):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path()))

    def text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """The file under this name, whole or not at all; False if there is one already."""
        self._fs.mkdirs(self._path())
        draft = self._path(f".{name}.{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf)
        no_flags = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, self._path(name), no_flags)
        except Exception as exc:
            if "FileAlreadyExistsException" not in str(exc):
                raise
            self._fs.delete(draft, False)
            return False
        return True


class Conflict(RuntimeError):
    """Another writer has put a version in place since this one was begun."""


class VersionedTable:
    """Rows dealt out to a fixed number of buckets by a key; a change writes the buckets it touches anew and leaves the rest.

    schema: of the rows. A bucket is a list of folders, so an append adds one and a rewrite leaves one. The manifest names at most
    `buckets` lists. Many rows with one key are one bucket on disk, but are joined and written by many tasks, dealt out by all their
    columns.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._manifests = Folder(spark, f"{self.path}/manifests")

    # --- reading

    def versions(self) -> list[str]:
        return [n for n in self._manifests.names() if n.endswith(".json") and not n.startswith(".")]

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest, or the one of a version; an empty one before the first change."""
        for name in reversed(self.versions()):
            if version is None or int(name.split(".")[0]) == version:
                return json.loads(self._manifests.text(name))
        if version:
            raise KeyError(f"no version {version}")
        return {"version": 0, "runs": [], "buckets": {}}

    def read(self, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of a version (default: the newest one), of all buckets or some."""
        of = self.manifest(version)["buckets"]
        wanted = of if buckets is None else [str(b) for b in buckets if str(b) in of]
        folders = [f"{self.path}/data/{folder}" for b in wanted for folder in of[b]]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def bucket(self, key: str | Column | None = None) -> Column:
        """The bucket that a key belongs to; null keys have one as well."""
        col = F.col(key or self.key) if not isinstance(key, Column) else key
        return F.pmod(F.xxhash64(col), F.lit(self.buckets)).cast("int")

    def for_keys(self, keys: Iterable) -> DataFrame:
        """The rows with one of these keys, read from their buckets alone."""
        kind = self.schema[self.key].dataType
        asked = self.spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField(self.key, kind)]))
        return self.read(buckets=self._touched(asked)).join(F.broadcast(asked.distinct()), self.key)  # the keys of one request

    # --- changes

    def append(self, rows: DataFrame, run: str) -> int:
        """New rows beside the old ones. The version after it."""
        return self._change(run, lambda before: {b: [*before["buckets"].get(b, []), f] for b, f in self._written(rows).items()})

    def delete(self, requests: DataFrame, on: list[str], run: str) -> int:
        """Without the rows that agree with a request in the columns `on`, which hold the key. Requests for no row change nothing."""
        asked = requests.select(*on).distinct()
        return self._rewrite(asked, run, lambda old: old.join(asked, on, "left_anti"))

    def upsert(self, rows: DataFrame, on: list[str], run: str) -> int:
        """With these rows in place of those that agree with them in the columns `on`, which hold the key. Of several new rows for one
        place the greatest by all columns stays."""
        rest = [f.name for f in self.schema.fields if f.name not in on]
        best = rows.groupBy(*on).agg(F.max(F.struct(*rest)).alias("_r"))
        new = best.select(*[F.col(c) if c in on else F.col(f"_r.{c}").alias(c) for c in self.schema.fieldNames()])
        return self._rewrite(new, run, lambda old: old.join(new.select(*on), on, "left_anti").unionByName(new))

    def _touched(self, rows: DataFrame) -> list[int]:
        """Numbers of buckets: at most `buckets` of them come to the driver."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def _rewrite(self, asked: DataFrame, run: str, change: Callable[[DataFrame], DataFrame]) -> int:
        def swap(before: dict) -> dict:
            touched = self._touched(asked)
            new = self._written(change(self.read(before["version"], touched)))
            return {str(b): [new[str(b)]] if str(b) in new else [] for b in touched}

        return self._change(run, swap)

    def _written(self, rows: DataFrame) -> dict[str, str]:
        """The rows under new folders, one per bucket that has any: bucket -> folder."""
        name = uuid.uuid4().hex
        dealt = rows.select(*self.schema.fieldNames()).withColumn(BUCKET, self.bucket())
        dealt.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{name}")
        found = [n for n in Folder(self.spark, f"{self.path}/data/{name}").names() if n.startswith(f"{BUCKET}=")]
        return {n.split("=")[1]: f"{name}/{n}" for n in found}

    def _change(self, run: str, change: Callable[[dict], dict]) -> int:
        before = self.manifest()
        if run in before["runs"]:
            return before["version"]
        after = {b: folders for b, folders in (before["buckets"] | change(before)).items() if folders}
        version = before["version"] + 1
        text = json.dumps({"version": version, "runs": [*before["runs"], run], "buckets": after}, sort_keys=True)
        if not self._manifests.put_new(f"{version:012d}.json", text):
            raise Conflict(f"version {version} was put in place meanwhile; repeat the run")
        return version
