"""Whole answers of the service, each from one pass over its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foyer.functions.scalars import contains_ascii_ci, drop_percent, euros, source_rank
from foyer.operators.projection import order
from foyer.operators.search import SearchFilters, conditions, numbered, ordering
from foyer.schemas import SOURCES
from foyer.session import stored


def listed(properties: DataFrame, publications: DataFrame, reactions: DataFrame, ranks: DataFrame, f: SearchFilters) -> tuple[DataFrame, DataFrame]:
    """(rows, total): all rows of a list that f asks for, stored once, and how many, as one row.

    Publications are folded once, to what a property's row shows and what f asks of
    them: whether one is active, of the source, or says the text; the sources, the number
    and the url of the primary.  So each table is read once, whatever page is asked for;
    pages come from the stored rows.
    """
    said = contains_ascii_ci(F.col("description"), f.text) if f.text else F.lit(False)
    sources = F.transform(F.array_sort(F.collect_set(F.struct(source_rank(F.col("source"), SOURCES).alias("r"), "source"))), lambda x: x["source"])
    active = publications.filter("is_active").groupBy(F.col("property_id").alias("_pid")).agg(sources.alias("sources"), F.count("*").alias("n_publications"), F.min_by("url", order()).alias("primary_url"), F.coalesce(F.bool_or(said), F.lit(False)).alias("_said"))
    own = properties
    for condition in conditions(f, False):
        own = own.filter(condition)
    rows = own.join(active, F.col("id") == F.col("_pid"))
    if f.source:
        rows = rows.filter(F.array_contains("sources", f.source))
    if f.text:
        rows = rows.filter(F.coalesce(contains_ascii_ci(F.col("title"), f.text), F.lit(False)) | F.col("_said"))
    reacted = reactions.select(F.col("property_id").alias("_rid"), F.col("type").alias("reaction"))
    rows = rows.join(reacted, F.col("id") == F.col("_rid"), "left")
    if f.without_reaction:
        rows = rows.filter("_rid is null")
    rows = rows.join(ranks.select(F.col("id").alias("_kid"), "score", "rank", "rank_total"), F.col("id") == F.col("_kid"), "left")
    shown = rows.drop("_pid", "_said", "_rid", "_kid").withColumns({"price_label": euros(F.col("price")), "price_drop_percent": drop_percent(F.col("first_price"), F.col("price"))})
    kept = stored(shown, "listed")
    return kept, kept.agg(F.count("*").alias("total"))


def list_answer(properties: DataFrame, publications: DataFrame, reactions: DataFrame, ranks: DataFrame, f: SearchFilters) -> DataFrame:
    """The page of a list with at, the place of each row, and total, the number of all rows; an empty page has no rows."""
    rows, total = listed(properties, publications, reactions, ranks, f)
    by = ordering(f.sort, False)
    page = numbered(rows.orderBy(*by).offset(f.offset).limit(f.limit), by, offset=f.offset)
    return page.crossJoin(F.broadcast(total))  # one row


def statistics_answer(properties: DataFrame, publications: DataFrame, cities: int = 10) -> DataFrame:
    """section, key, value: the counts of all statistics sections, each table read once.

    overview: properties, active_properties, price_drops (of active ones), publications,
    inactive_publications, multi_source; sources: a row for each known source and state;
    cities: the ``cities`` with most properties.  Publications are folded to a row for
    each property, beside which a row without a property carries the counts by source.
    """
    counts = {f"{s}.{state}": F.count_if((F.col("source") == s) & (F.col("is_active") == (state == "active"))) for s in SOURCES for state in ("active", "inactive")}
    totals = {"publications": F.count_if("is_active"), "inactive_publications": F.count_if(~F.col("is_active"))}
    own = publications.groupBy(F.col("property_id").alias("_pid")).agg(F.bool_or("is_active").alias("live"), (F.size(F.collect_set(F.when(F.col("is_active"), F.col("source")))) > 1).alias("several"), *(c.alias(n) for n, c in (counts | totals).items()))
    joined = properties.select("id", "city", (F.col("first_price") > F.col("price")).alias("fell")).join(own, F.col("id") == F.col("_pid"), "full")
    here, live = F.col("id").isNotNull(), F.coalesce("live", F.lit(False))
    measured = {"properties": F.count_if(here), "active_properties": F.count_if(here & live), "price_drops": F.count_if(here & live & F.col("fell")), "multi_source": F.count_if(F.coalesce("several", F.lit(False)))}
    summed = {n: F.coalesce(F.sum(f"`{n}`"), F.lit(0)) for n in (*totals, *counts)}
    by_city = stored(joined.groupBy("city").agg(*(c.alias(n) for n, c in (measured | summed).items())), "statistics")  # a row for each city
    entries = [F.struct(F.lit("sources" if "." in n else "overview").alias("section"), F.lit(n).alias("key"), F.col(f"`{n}`").cast("long").alias("value")) for n in (*measured, *summed)]
    over_all = by_city.agg(*(F.coalesce(F.sum(f"`{n}`"), F.lit(0)).alias(n) for n in (*measured, *summed)))
    whole = over_all.select(F.inline(F.array(*entries)))
    top = by_city.filter("properties > 0").orderBy(F.desc("properties"), "city").limit(cities)
    return whole.unionByName(top.select(F.lit("cities").alias("section"), F.col("city").alias("key"), F.col("properties").cast("long").alias("value")))
