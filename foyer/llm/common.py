"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of text that one step of a Python task holds as arrays.
BATCH_BYTES = 2 << 20
#: Rows of an Arrow batch.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir.

    Only a local session without that setting (tests) gets a temporary one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        # a running session takes no new value of spark.checkpoint.dir, so its context remembers the folder
        context.setCheckpointDir(tempfile.mkdtemp(prefix="foyer-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/foyer/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts lineage: a lost executor costs the tasks after it, not those before.
    The shuffle files of the job go when it ends, so a job's peak is its own.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        df.write.option("compression", "zstd").mode("overwrite").parquet(path)
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Empties tables of store() that nothing will read again, so that they hold no disk."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(folder)


def bound_batches(spark: SparkSession) -> None:
    """Python tasks of this session get at most BATCH_ROWS rows at a time: texts are long, and an Arrow batch is held several times."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, BATCH_ROWS)


def by_bytes(rows: list, size, limit: int = BATCH_BYTES) -> Iterator[list]:
    """Consecutive runs of rows of about limit bytes; a larger row stands alone."""
    part, held = [], 0
    for row in rows:
        n = size(row)
        if part and held + n > limit:
            yield part
            part, held = [], 0
        part.append(row)
        held += n
    if part:
        yield part


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=False) for c, f in zip(columns, schema)], schema=schema)


def utf8(column: str | Column) -> Column:
    """The text as bytes; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def row_key(*columns: str) -> Column:
    return F.xxhash64(*columns)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for internal use that df does not have."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def number_rows(df: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """df with row_no from 0 in the order of these columns, and its row count.

    Range partitions are written in order; counts of the partitions (a row for
    each) give each its first number.  Rows that are equal in order are dealt to ranges
    by a number of their own, so that very many of them don't meet in one.
    """
    at_, tie_ = fresh(df, "at_in_file", "tie")
    tied = df.withColumn(tie_, F.monotonically_increasing_id())
    ordered = store(tied.repartitionByRange(*order, tie_).sortWithinPartitions(*order, tie_).drop(tie_).withColumn(at_, F.monotonically_increasing_id()), "numbered")
    part, within = F.shiftright(at_, 33), F.col(at_).bitwiseAND((1 << 33) - 1)
    counts = ordered.groupBy(part.alias("part")).count()
    first = counts.select(F.col("part").alias("_part"), (F.sum("count").over(W.orderBy("part")) - F.col("count")).alias("_first"))
    n = ordered.count()
    # one row for each range partition: their number is that of shuffle partitions
    return ordered.join(F.broadcast(first), part == F.col("_part")).withColumn("row_no", F.col("_first") + within).drop("_part", "_first", at_), n


def keyed(docs: DataFrame) -> DataFrame:
    """docs with _key, a number of its own for each row, and _order, the rank of its doc_id.

    Where every doc_id is there once, both are the doc_id.  Else rows are numbered;
    rows that share a doc_id keep one rank, and null ranks before all others.
    """
    n, own, least = docs.agg(F.count("*"), F.countDistinct("doc_id"), F.min("doc_id")).first()
    if n == own:
        return docs.withColumns({"_key": F.col("doc_id"), "_order": F.col("doc_id")})
    numbered, _ = number_rows(docs.withColumn("_order", F.coalesce("doc_id", F.lit((least or 0) - 1))), "_order", "text")
    return numbered.withColumnRenamed("row_no", "_key")


def shielded(df: DataFrame, used: Sequence[str], new: Sequence[str] = ()) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df for an operator that reads ``used``, and a function that gives the other columns their names back.

    Inside, the others have names that nothing of the operator's can clash with;
    those with the names of ``new`` columns are replaced, so they go.
    """
    gone = {c.lower() for c in (*used, *new)}
    inner = {c: f"_carried_{k}" for k, c in enumerate(df.columns) if c.lower() not in gone}
    own = df.select(*used, *(F.col(f"`{c}`").alias(n) for c, n in inner.items()))
    return own, lambda out: out.withColumnsRenamed({n: c for c, n in inner.items()})


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHash:
    """Hashes of spans [i, j) of a sequence of 64-bit values: a polynomial modulo 2**64 with an odd base, then mixed.

    Powers are kept for the longest sequence so far, so a batch costs a product and a running sum.
    """

    _BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    _powers = _inverses = np.ones(1, "uint64")

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls._powers) < n:
            m = 1 << (n - 1).bit_length()
            for name, base in (("_powers", cls._BASE), ("_inverses", cls._INVERSE)):
                p = np.full(m, base, "uint64")
                p[0] = 1
                setattr(cls, name, np.cumprod(p, dtype="uint64"))

    def __init__(self, values: np.ndarray):
        n = len(values)
        self._grow(n + 1)
        self.sums = np.zeros(n + 1, "uint64")
        np.cumsum(values * self._powers[:n], dtype="uint64", out=self.sums[1:])

    def raw(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (self.sums[j] - self.sums[i]) * self._inverses[i]

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return mix64(self.raw(i, j) ^ (j - i).astype("uint64"))
