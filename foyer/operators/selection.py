"""Exact order statistics without one buffer of all values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foyer.session import stored


def percentiles(df: DataFrame, value: Column | str, shares: Sequence[float]) -> DataFrame:
    """One row: n, the number of values that aren't null, and p0, p1, ... for shares, as percentile() interpolates.

    Equal values are one row with their number, counted before any shuffle.  These rows
    are dealt to ranges of the value; the numbers of the ranges, a row for each, tell
    which ranges hold the ranks asked for, and only these are sorted.  Without values
    all are null.
    """
    value = F.col(value) if isinstance(value, str) else value
    counts = df.select(value.alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    ranges = stored(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "values")
    sizes = ranges.groupBy("part").agg(F.sum("n").alias("size"))
    # a row for each range: their number is that of shuffle partitions
    placed = sizes.select("part", (F.sum("size").over(W.orderBy("part")) - F.col("size")).alias("before"), "size", F.sum("size").over(W.partitionBy()).alias("total"))
    at = [(F.col("total") - 1) * F.lit(float(p)) for p in shares]
    asked = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(a), F.ceil(a)) for a in at))))
    holding = placed.withColumn("ranks", F.filter(asked, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("size")))).filter(F.size("ranks") > 0)
    within = W.partitionBy("part").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    rows = ranges.join(F.broadcast(holding), "part").withColumn("upto", F.col("before") + F.sum("n").over(within))
    hits = rows.select("v", F.explode(F.filter("ranks", lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto")))).alias("rank"))
    found = hits.agg(F.map_from_entries(F.collect_list(F.struct("rank", F.col("v").cast("double").alias("v")))).alias("found"))  # two for each share
    total = placed.agg(F.coalesce(F.max("total"), F.lit(0)).alias("total"))
    value_at = lambda r: F.try_element_at("found", r.cast("long"))
    between = [value_at(F.floor(a)) + (value_at(F.ceil(a)) - value_at(F.floor(a))) * (a - F.floor(a)) for a in at]
    return total.crossJoin(found).select(F.col("total").alias("n"), *(b.alias(f"p{k}") for k, b in enumerate(between)))  # one row each
