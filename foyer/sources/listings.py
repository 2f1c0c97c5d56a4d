"""Listings as files: JSON lines from connectors, Parquet tables of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foyer.operators.enrichment import split_valid
from foyer.schemas import listing_schema


def read_listings(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """Ads of JSON-lines files as (valid, rejected); fields that the schema doesn't have are passed over."""
    return split_valid(spark.read.schema(listing_schema()).json(list(paths)))


def write_publications(listings: DataFrame, path: str) -> None:
    """A folder for each source, so that a source's refresh replaces and reads its own files only."""
    listings.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("source").parquet(path)
