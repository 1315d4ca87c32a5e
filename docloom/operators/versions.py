"""Tables by versions: a folder with a manifest for each version, which names the files that belong to it.

A version is there as soon as its manifest is. The manifest is written beside and renamed, which fails if another writer was there first, so of two writers that began with one version the second is refused. Files are never changed; a reader of
an older version goes on with that version's files until expire() takes them away.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.session import broadcast_if_small


class Conflict(RuntimeError):
    """Another writer has made this version."""


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    """(file system, the path for it)"""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that are there, ascending."""
    fs, folder = _fs(spark, f"{path}/manifests")
    if not fs.exists(folder):
        return []
    return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))


def manifest(spark: SparkSession, path: str, version: int) -> dict:
    fs, file = _fs(spark, f"{path}/manifests/{version}.json")
    if not fs.exists(file):
        raise ValueError(f"there is no version {version}")
    lines = spark.read.text(f"{path}/manifests/{version}.json", wholetext=True).first()
    return json.loads(lines.value)


def commit(spark: SparkSession, path: str, version: int, content: dict) -> None:
    """Makes a version, or raises Conflict if it is there."""
    fs, file = _fs(spark, f"{path}/manifests/{version}.json")
    _, beside = _fs(spark, f"{path}/manifests/{version}.{uuid.uuid4().hex}.tmp")
    fs.mkdirs(file.getParent())
    out = fs.create(beside, False)
    out.write(json.dumps(content).encode())
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    kinds = getattr(hadoop, "Options$Rename")
    none = spark.sparkContext._gateway.new_array(kinds, 0)  # without OVERWRITE
    try:
        hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), fs.makeQualified(file), none)
    except Exception as e:
        fs.delete(beside, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"version {version} of {path} is there already") from e
        raise


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _fs(spark, path)
    fs.delete(target, True)


def _nullable(kind: T.DataType) -> T.DataType:
    """The type with nulls allowed everywhere, as rows that come later may have some."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_nullable(kind.elementType))
    return T.MapType(_nullable(kind.keyType), _nullable(kind.valueType)) if isinstance(kind, T.MapType) else kind


@dataclass(frozen=True)
class BucketTable:
    """Rows in buckets of a key. An upsert or delete copies the buckets that it touches and keeps the files of the others."""

    spark: SparkSession
    path: str
    version: int
    content: dict = field(repr=False)

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, buckets: int, sort: tuple[str, ...] = ()) -> BucketTable:
        """A new table of rows, its version 0. sort: columns that a bucket's files are sorted by, after the key."""
        spark = rows.sparkSession
        content = {"key": key, "buckets": buckets, "sort": list(sort), "schema": _nullable(rows.schema).json(), "files": {}}
        table = cls(spark, path, -1, content)
        return table._committed(table._written(rows), {})

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> BucketTable:
        """A version of the table, the last one if none is named."""
        there = versions(spark, path)
        if not there:
            raise ValueError(f"there is no table at {path}")
        version = there[-1] if version is None else version
        return cls(spark, path, version, manifest(spark, path, version))

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.content["schema"]))

    def bucket(self, key: Column | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(self.content["key"]) if key is None else key), F.lit(self.content["buckets"])).cast("int")

    def read(self) -> DataFrame:
        return self._files([f for files in self.content["files"].values() for f in files])

    def of(self, keys: list) -> DataFrame:
        """Rows of a few keys, from their buckets' files alone."""
        kind = self.schema[self.content["key"]].dataType
        asked = self.spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField("k", kind)]))
        numbers = {str(r.b) for r in asked.select(self.bucket(F.col("k")).alias("b")).distinct().collect()}
        return self._files([f for b in numbers for f in self.content["files"].get(b, [])]).where(F.col(self.content["key"]).isin(keys))

    def _files(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in files])

    def _written(self, rows: DataFrame) -> dict[str, list[str]]:
        """Writes rows by bucket; the new files of each bucket, as the manifest has them. A bucket is one task's unless it is split by size."""
        name = f"data/{uuid.uuid4().hex}"
        key = self.content["key"]
        most = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).withColumn("_bucket", self.bucket())
        dealt.repartition(min(self.content["buckets"], 4 * most), "_bucket").sortWithinPartitions("_bucket", key, *self.content["sort"]).write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        fs, folder = _fs(self.spark, f"{self.path}/{name}")
        found: dict[str, list[str]] = {}
        for part in fs.listStatus(folder):
            label = part.getPath().getName()
            if label.startswith("_bucket="):
                found[label[8:]] = sorted(f"{name}/{label}/{s.getPath().getName()}" for s in fs.listStatus(part.getPath()) if s.getPath().getName().startswith("part-"))
        return found

    def _committed(self, new: dict[str, list[str]], kept: dict[str, list[str]]) -> BucketTable:
        content = {**self.content, "files": {**kept, **new}, "written": sorted(map(int, new))}
        commit(self.spark, self.path, self.version + 1, content)
        return BucketTable(self.spark, self.path, self.version + 1, content)

    def replace(self, keys: DataFrame, rows: DataFrame | None) -> BucketTable:
        """The next version: rows of the keys go, `rows` come, whose keys are among them."""
        key = self.content["key"]
        gone = keys.select(F.col(key).alias("_gone")).distinct()
        touched = {str(r.b) for r in gone.select(self.bucket(F.col("_gone")).alias("b")).distinct().collect()}  # numbers of buckets
        old = self._files([f for b in touched for f in self.content["files"].get(b, [])])
        new = old.join(broadcast_if_small(gone), F.col(key).eqNullSafe(F.col("_gone")), "left_anti")
        if rows is not None:
            new = new.unionByName(rows.select(*old.columns))
        return self._committed(self._written(new), {b: f for b, f in self.content["files"].items() if b not in touched})

    def upsert(self, rows: DataFrame) -> BucketTable:
        """The next version: all rows of the keys of `rows` give way to `rows`. Raises Conflict if another writer has made it."""
        return self.replace(rows, rows)

    def remove(self, keys: DataFrame) -> BucketTable:
        """The next version, without the rows of the keys."""
        return self.replace(keys, None)


def expire(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Takes away all versions but the last `keep`, and files that only they have. Returns how many files went. To be called when no reader or writer of them is left."""
    there = versions(spark, path)
    old, last = there[:-keep], there[-keep:]
    names = lambda v: {f for files in manifest(spark, path, v)["files"].values() for f in files}
    needed = set().union(*map(names, last)) if last else set()
    lost = set().union(*map(names, old)) - needed if old else set()
    for v in old:
        delete(spark, f"{path}/manifests/{v}.json")
    for f in lost:
        delete(spark, f"{path}/{f}")
    return len(lost)
