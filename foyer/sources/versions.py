"""Tables of a store that change together, in buckets: a batch writes the buckets that it meets, then one pointer names them.

A table is cut by its key into buckets, each a folder that is never written again.  A
version is a list of one folder for each filled bucket of each table; versions are numbered, and
a pointer file for each number is created once.  A writer that began from a version that
is no longer the last finds its number taken and gets a Conflict: nothing that it wrote is
read by anyone.  Readers see a whole version; those that read an older one keep it.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTRIES = "name string, bucket int, folder string, since long"


class Conflict(RuntimeError):
    """Another writer published since this one began."""


def bucket(key: Column | str, buckets: int) -> Column:
    """The bucket of a key: its remainder; null is in the first."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.pmod(key, F.lit(buckets)), F.lit(0)).cast("int")


class Store:
    """Tables under root; keys: the column that each is cut by."""

    def __init__(self, spark: SparkSession, root: str, keys: Mapping[str, str], buckets: int = 64):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), dict(keys), buckets
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # ------------------------------------------------------------ pointers

    def _path(self, name: str):
        return self._jvm.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self._conf)

    def sequence(self) -> int:
        """The number of the last version; 0 before the first."""
        fs, at = self._fs(), self._path("_pointers")
        if not fs.exists(at):
            return 0
        return max((int(f.getPath().getName()) for f in fs.listStatus(at) if f.getLen() and f.getPath().getName().isdigit()), default=0)

    def _claim(self, number: int, entries: str) -> None:
        """Creates the pointer of a version, unless another writer did: one small file, which the file system creates once."""
        try:
            out = self._fs().create(self._path(f"_pointers/{number:020d}"), False)
        except Exception as error:
            if "AlreadyExists" in str(error) or "already exists" in str(error):
                raise Conflict(f"version {number} of {self.root} is taken") from error
            raise
        out.write(bytearray(entries.encode()))
        out.close()

    def entries(self, number: int | None = None) -> DataFrame:
        """name, bucket, folder, since: the filled buckets of a version, the last unless given; since: the version that wrote it."""
        number = self.sequence() if number is None else number
        if not number:
            return self.spark.createDataFrame([], _ENTRIES)
        folder = self.spark.read.text(f"{self.root}/_pointers/{number:020d}", wholetext=True).first()[0]
        return self.spark.read.schema(_ENTRIES).parquet(f"{self.root}/{folder}")

    # ------------------------------------------------------------ tables

    def read(self, name: str, number: int | None = None, only: set[int] | None = None) -> DataFrame:
        """A table of a version, the last unless given; only: the buckets to read, others aren't opened."""
        own = self.entries(number).filter(F.col("name") == name).select("bucket", "folder").collect()  # buckets at most
        if not own:
            raise ValueError(f"no table {name} in {self.root}")
        folders = [r.folder for r in own if only is None or r.bucket in only]
        if not folders:
            return self.spark.createDataFrame([], self.spark.read.parquet(f"{self.root}/{own[0].folder}").schema)
        return self.spark.read.parquet(*(f"{self.root}/{f}" for f in folders))

    def since(self, name: str, number: int | None = None) -> DataFrame:
        """bucket, since: which version wrote a table's buckets."""
        return self.entries(number).filter(F.col("name") == name).select("bucket", "since")

    def publish(self, tables: Mapping[str, DataFrame], touched: Mapping[str, DataFrame] | None = None, base: int | None = None) -> int:
        """A new version with these tables, and its number; others stay as they are.

        touched: for a table the keys, as a column of their own, that the batch met; only
        their buckets are written, the others keep their files.  Without it all are.
        base: the version that the writer began from (the last, unless given); a later one
        by another writer is a Conflict.
        """
        base = self.sequence() if base is None else base
        if self.sequence() != base:
            raise Conflict(f"{self.root} is at version {self.sequence()}, not {base}")
        number, version, rows = base + 1, uuid.uuid4().hex, []
        old = [tuple(r) for r in self.entries(base).collect()]  # tables times buckets
        for name, df in tables.items():
            met = set(range(self.buckets))
            if touched is not None and name in touched and any(r[0] == name for r in old):
                met = {r[0] for r in touched[name].select(bucket(F.col(touched[name].columns[0]), self.buckets)).distinct().collect()}
            rows += [r for r in old if r[0] == name and r[1] not in met]
            if met:
                own = df.withColumn("_bucket", bucket(self.keys[name], self.buckets))
                own = own if len(met) == self.buckets else own.filter(F.col("_bucket").isin(sorted(met)))
                # the rows of a bucket meet in a file or a few, also where many tasks made them; a large bucket is written by several tasks
                own.hint("rebalance", F.col("_bucket")).write.partitionBy("_bucket").parquet(f"{self.root}/{name}/{version}")
                rows += [(name, k, f"{name}/{version}/_bucket={k}", number) for k in self._filled(f"{name}/{version}") if k in met]
            if not any(r[0] == name for r in rows):  # a table without rows keeps its columns
                df.limit(0).write.parquet(f"{self.root}/{name}/{version}-empty")
                rows.append((name, -1, f"{name}/{version}-empty", number))
        rows += [r for r in old if r[0] not in tables]
        self.spark.createDataFrame(rows, _ENTRIES).coalesce(1).write.parquet(f"{self.root}/_versions/{version}")
        self._claim(number, f"_versions/{version}")
        return number

    def _filled(self, folder: str) -> list[int]:
        names = (f.getPath().getName() for f in self._fs().listStatus(self._path(folder)))
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith("_bucket="))

    def prune(self, keep: int = 2) -> int:
        """Deletes the folders that none of the last ``keep`` versions names, and tells how many; older readers lose theirs."""
        last = self.sequence()
        wanted = {r.folder for k in range(max(1, last - keep + 1), last + 1) for r in self.entries(k).select("folder").collect()}
        fs, gone = self._fs(), 0
        for k in range(1, last - keep + 1):
            if not fs.exists(self._path(f"_pointers/{k:020d}")):
                continue
            for r in self.entries(k).select("folder").collect():
                if r.folder not in wanted:
                    gone += fs.delete(self._path(r.folder), True)
        for k in range(1, last - keep + 1):
            fs.delete(self._path(f"_pointers/{k:020d}"), False)
        return gone
