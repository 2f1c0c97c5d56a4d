"""Rows as the service answers with them: lists, details, descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foyer.functions.scalars import drop_percent, euros, source_rank
from foyer.operators.projection import order
from foyer.operators.search import with_reactions
from foyer.schemas import SOURCES

# The fields by which a publication is shown beside its property.
DELTA_FIELDS = ("price", "surface", "rooms", "bedrooms", "land_surface", "title")


def descriptions(publications: DataFrame) -> DataFrame:
    """property_id, descriptions: of active publications with a text, in the order of projection."""
    own = publications.filter("is_active and trim(description) <> ''")
    listed = F.array_sort(F.collect_list(F.struct(order().alias("o"), "source", "description")))
    return own.groupBy("property_id").agg(F.transform(listed, lambda x: F.struct(x["source"].alias("source"), x["description"].alias("description"))).alias("descriptions"))


def publication_details(properties: DataFrame, publications: DataFrame, names: tuple[str, ...] = DELTA_FIELDS) -> DataFrame:
    """property_id, publications: the active ones in the order of projection, each with the fields in which it differs (null elsewhere) and delta, whether there are any."""
    own = [n for n in names if n in publications.columns and n in properties.columns]
    base = properties.select(F.col("id").alias("_pid"), *(F.col(n).alias(f"_{n}") for n in own))
    joined = publications.filter("is_active").join(base, F.col("property_id") == F.col("_pid"))
    differs = {n: ~F.col(n).eqNullSafe(F.col(f"_{n}")) for n in own}
    row = F.struct(order().alias("o"), F.col("id"), F.col("source"), F.col("url"), F.array_compact(F.array(*(F.when(d, n) for n, d in differs.items()))).alias("fields"), *(F.when(d, F.col(n)).alias(n) for n, d in differs.items()))
    listed = F.transform(F.array_sort(F.collect_list(row)), lambda x: x.dropFields("o").withField("delta", F.size(x["fields"]) > 0))
    return joined.groupBy("property_id").agg(listed.alias("publications"))


def listing_rows(page: DataFrame, publications: DataFrame, reactions: DataFrame, ranks: DataFrame) -> DataFrame:
    """A page of properties as list rows: sources, reaction, compatibility rank, price labels, photo.

    publications, reactions and ranks(id, score, rank, rank_total) are joined to the page;
    what a property doesn't have is null (sources: empty).
    """
    ids = page.select(F.col("id").alias("_pid"))
    active = publications.filter("is_active").join(ids, F.col("property_id") == F.col("_pid"), "left_semi")
    sources = F.transform(F.array_sort(F.collect_set(F.struct(source_rank(F.col("source"), SOURCES).alias("r"), "source"))), lambda x: x["source"])
    grouped = active.groupBy("property_id").agg(sources.alias("sources"), F.count("*").alias("n_publications"), F.min_by("url", order()).alias("primary_url"))
    joined = with_reactions(page, reactions).join(grouped, F.col("id") == F.col("property_id"), "left").drop("property_id").join(ranks.select(F.col("id").alias("_rid"), "score", "rank", "rank_total"), F.col("id") == F.col("_rid"), "left").drop("_rid")
    return joined.withColumns({"sources": F.coalesce("sources", F.array().cast("array<string>")), "n_publications": F.coalesce("n_publications", F.lit(0)), "price_label": euros(F.col("price")), "price_drop_percent": drop_percent(F.col("first_price"), F.col("price"))})


# The labels of a summary's specs.
SPEC_LABELS = {"surface": " m²", "land_surface": " m² land", "rooms": " rooms", "bedrooms": " beds"}


def summary(rows: DataFrame) -> DataFrame:
    """rows(id, title, city, postal_code, price, first_price, surface, land_surface, rooms, bedrooms, sources, tier, reaction) with location_line, specs_line, badges and detail_path.

    badges: kind and label, in their order: the id, each source (or that there is none),
    the tier, the reaction, the price drop.  What a property doesn't have, or has as 0, is
    left out.
    """
    number = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")
    specs = [F.when(F.col(c) != 0, F.concat(number(c), F.lit(label))) for c, label in SPEC_LABELS.items()]
    badge = lambda kind, label=None: F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (F.lit(None).cast("string") if label is None else label).alias("label"))
    some = lambda condition, *badges: F.when(condition, F.array(*badges)).otherwise(F.array().cast("array<struct<kind:string,label:string>>"))
    fell = F.coalesce((F.col("first_price") > F.col("price")) & (F.col("first_price") > 0), F.lit(False))
    drop = F.concat(euros(F.col("first_price") - F.col("price")), F.lit(" (−"), drop_percent(F.col("first_price"), F.col("price")).cast("string"), F.lit(" %)"))
    badges = F.concat(
        F.array(badge("id", F.col("id").cast("string"))),
        F.when(F.size("sources") > 0, F.transform("sources", lambda s: badge("source", s))).otherwise(F.array(badge("publications-unavailable"))),
        some(F.coalesce(F.col("tier") != "", F.lit(False)), badge("compatibility", F.col("tier"))),
        some(F.coalesce(F.col("reaction").isin("like", "dislike"), F.lit(False)), badge(F.concat(F.lit("reaction-"), F.col("reaction")))),
        some(fell, badge("price-drop", drop)),
    )
    place = F.concat_ws(" ", F.nullif(F.col("city"), F.lit("")), F.when(F.col("postal_code") != "", F.concat(F.lit("("), F.col("postal_code"), F.lit(")"))))
    return rows.withColumns({"location_line": place, "specs_line": F.concat_ws(" · ", *specs), "badges": badges, "detail_path": F.concat(F.lit("/listings/"), F.col("id").cast("string"))})


def detail(properties: DataFrame, publications: DataFrame, id_: int) -> DataFrame:
    """The row of an id with its publications' differences and descriptions."""
    own = properties.filter(F.col("id") == id_)
    mine = publications.filter(F.col("property_id") == id_)
    joined = own.join(publication_details(own, mine).withColumnRenamed("property_id", "_p1"), F.col("id") == F.col("_p1"), "left").join(descriptions(mine).withColumnRenamed("property_id", "_p2"), F.col("id") == F.col("_p2"), "left")
    return joined.drop("_p1", "_p2")
