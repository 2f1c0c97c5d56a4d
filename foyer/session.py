"""A session with the settings that the engine relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def build_session(name: str = "foyer", shuffle_partitions: int | None = None, master: str | None = None) -> SparkSession:
    """UTC days, adaptive plans with skew handling; partitions are left to adaptive coalescing unless given."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def kept(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the folder that spark.checkpoint.dir names, so that its lineage ends there.

    Only a local session without that setting (tests) gets a temporary folder.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = shared_dir(df.sparkSession)
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(folder)
    return df.checkpoint()


def spread(df: DataFrame, *key: str) -> DataFrame:
    """df dealt to tasks by a key, before work that costs much for each row: a file is read by its row groups, which may be fewer than the cores."""
    return df.repartition(*key)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir; only a local session without it (tests) gets a temporary one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        # a running session takes no new value of spark.checkpoint.dir, so its context remembers the folder
        context.setCheckpointDir(tempfile.mkdtemp(prefix="foyer-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: a table of a round, which gone() empties."""
    path = f"{shared_dir(df.sparkSession)}/foyer/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gone(*tables: DataFrame) -> None:
    """Empties tables of stored() that nothing will read again."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(folder)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with name, the place of a row in this order from 1, and name_total, the number of rows.

    Ranges of the order are sorted each in one task; their sizes, a row for each, say
    at which place a range starts.
    """
    own = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = own.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_above"), F.sum("_n").over(W.partitionBy()).alias(f"{name}_total"))
    return own.join(F.broadcast(before), part == F.col("_part")).withColumn(name, F.col("_above") + within + 1).drop("_part", "_at", "_above")
