"""Counts, price statistics, series, histogram, daily snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foyer.functions.scalars import euros, half_up, photo_key, week_label
from foyer.operators.selection import percentiles
from foyer.schemas import SOURCES
from foyer.session import numbered


def active_properties(properties: DataFrame, publications: DataFrame, source: str | None = None) -> DataFrame:
    """Properties with an active publication (of a source)."""
    on = publications.filter("is_active")
    if source:
        on = on.filter(F.col("source") == source)
    return properties.join(on.select(F.col("property_id").alias("_pid")), F.col("id") == F.col("_pid"), "left_semi")


def price_stats(active: DataFrame) -> DataFrame:
    """One row; nulls without rows.  The median is found by selection, so no task holds all prices."""
    rest = active.agg(F.count("*").alias("n"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), half_up(F.avg("price")).alias("avg_price"))
    return rest.crossJoin(median(active)).select("n", "min_price", "max_price", "median_price", "avg_price")  # one row each


def median(active: DataFrame) -> DataFrame:
    """One row: median_price."""
    return percentiles(active, "price", [0.5]).select(half_up(F.col("p0")).alias("median_price"))


def overview(properties: DataFrame, publications: DataFrame) -> DataFrame:
    """Counts of the overview section in one row, each table read once."""
    pubs = publications.agg(F.count_if("is_active").alias("publications"), F.count_if(~F.col("is_active")).alias("inactive_publications"))
    live = publications.filter("is_active").select(F.col("property_id").alias("_pid")).distinct()
    flagged = properties.join(live, F.col("id") == F.col("_pid"), "left")
    on = F.col("_pid").isNotNull()
    props = flagged.agg(F.count("*").alias("properties"), F.count_if(on).alias("active_properties"), F.count_if(on & (F.col("first_price") > F.col("price"))).alias("price_drops"))
    return props.crossJoin(pubs)  # one row each


def counts_by_source(publications: DataFrame) -> DataFrame:
    """source, active, inactive for each known source, zeros included."""
    known = publications.sparkSession.createDataFrame([(s,) for s in SOURCES], "source string")
    counts = publications.groupBy("source").agg(F.count_if("is_active").alias("active"), F.count_if(~F.col("is_active")).alias("inactive"))
    return known.join(counts, "source", "left").na.fill(0, ["active", "inactive"])


def top_cities(properties: DataFrame, limit: int = 10) -> DataFrame:
    return properties.groupBy("city").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "city").limit(limit)


def multi_source(publications: DataFrame) -> DataFrame:
    """How many properties have active publications of two sources or more."""
    per = publications.filter("is_active").groupBy("property_id").agg(F.countDistinct("source").alias("sources"))
    return per.filter("sources > 1").agg(F.count("*").alias("n"))


def largest_drops(active: DataFrame, limit: int = 10) -> DataFrame:
    drop = F.col("first_price") - F.col("price")
    return active.filter(drop > 0).select("id", "first_price", "price", drop.alias("price_drop")).orderBy(F.desc("price_drop"), "id").limit(limit)


def activity(publications: DataFrame, now: str, days: int = 7) -> DataFrame:
    """Scrapes and deactivations of the last days, and the latest scrape."""
    since = F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days")
    return publications.agg(F.count_if(F.col("scraped_at") >= since).alias("scraped"), F.count_if(~F.col("is_active") & (F.col("scraped_at") >= since)).alias("deactivated"), F.date_format(F.max("scraped_at"), "yyyy-MM-dd").alias("last_day"))


def by_day(df: DataFrame, ts: str) -> DataFrame:
    return df.groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def activity_by_day(properties: DataFrame, publications: DataFrame, since: str | None = None) -> DataFrame:
    """day, new_properties, scrapes, deactivations: three series joined in full by day, with 0 where one has no row.

    Properties count on the day they were first seen, publications on the day of their
    latest scrape, inactive ones on the day of their last update; each from since on.
    """
    after = lambda df, c: df if since is None else df.filter(F.col(c) >= F.lit(since).cast("timestamp_ntz"))
    series = {
        "new_properties": by_day(after(properties, "first_seen_at"), "first_seen_at"),
        "scrapes": by_day(after(publications, "scraped_at"), "scraped_at"),
        "deactivations": by_day(after(publications.filter("not is_active"), "updated_at"), "updated_at"),
    }
    named = [df.withColumnRenamed("n", name) for name, df in series.items()]
    joined = named[0].join(named[1], "day", "full").join(named[2], "day", "full")
    return joined.na.fill(0, list(series)).select("day", *series)


def reactions_by_week(reactions: DataFrame, since: str | None = None) -> DataFrame:
    """week, likes, dislikes of reactions(type, created_at), from since on."""
    own = reactions if since is None else reactions.filter(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    return own.groupBy(week_label(F.to_date("created_at")).alias("week")).agg(F.count_if(F.col("type") == "like").alias("likes"), F.count_if(F.col("type") == "dislike").alias("dislikes"))


def price_histogram(active: DataFrame, buckets: int = 8) -> DataFrame:
    """bucket, label, low, high, n of equal steps; a bucket ends one below the next, the last at the maximum; empty ones are left out.

    The limits are one row joined back; prices are aggregated to buckets before any shuffle.
    """
    limits = active.agg(F.min("price").alias("lo"), F.max("price").alias("hi"))
    step = F.greatest(F.ceil((F.col("hi") - F.col("lo")) / buckets), F.lit(1))
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("price") - F.col("lo")) / step), F.lit(buckets - 1)))
    counted = active.select("price").crossJoin(F.broadcast(limits)).groupBy(at.alias("bucket"), "lo", "hi").agg(F.count("*").alias("n"))
    low = F.col("lo") + F.col("bucket") * step
    high = F.when((F.col("bucket") == buckets - 1) | (F.col("hi") == F.col("lo")), F.col("hi")).otherwise(low + step - 1)
    return counted.select("bucket", low.alias("low"), high.alias("high"), "n").withColumn("label", F.when(F.col("low") == F.col("high"), euros(F.col("low"))).otherwise(F.concat(euros(F.col("low")), F.lit(" – "), euros(F.col("high")))))


def snapshot(properties: DataFrame, publications: DataFrame, day: str) -> DataFrame:
    """The row of a day in the snapshot table."""
    active = active_properties(properties, publications)
    own = active.agg(F.count("*").alias("active_properties"), F.count_if(F.col("first_price") > F.col("price")).alias("price_drop_count"))
    return own.crossJoin(median(active)).crossJoin(publications.agg(F.count_if("is_active").alias("active_publications"))).select(F.lit(day).alias("date"), "active_properties", "active_publications", "median_price", "price_drop_count")


def upsert_snapshot(snapshots: DataFrame, row: DataFrame) -> DataFrame:
    return snapshots.join(row.select("date"), "date", "left_anti").unionByName(row)


def missing_days(snapshots: DataFrame, first: str, last: str) -> DataFrame:
    """Days of the calendar that the table (date string) lacks."""
    calendar = snapshots.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("date"))
    return calendar.join(snapshots.select("date").distinct(), "date", "left_anti")


def backfill(snapshots: DataFrame, row: DataFrame, first: str, last: str) -> DataFrame:
    """Missing days with the metrics of row, as the present day has them."""
    days = missing_days(snapshots, first, last)
    return snapshots.unionByName(days.crossJoin(row.drop("date")))


def overused_photos(publications: DataFrame, least: int = 3) -> DataFrame:
    """Photo urls that many properties use: syndicated pictures."""
    urls = publications.select("property_id", F.explode("image_urls").alias("url"))
    return urls.groupBy("url").agg(F.countDistinct("property_id").alias("n")).filter(F.col("n") >= least).select(photo_key(F.col("url")).alias("photo")).distinct()


def ranked(df: DataFrame, score: str = "score") -> DataFrame:
    """rank 1..n by score (null counts as 0), then id, and rank_total."""
    return numbered(df, [F.desc(F.coalesce(score, F.lit(0.0))), F.asc("id")], "rank")
