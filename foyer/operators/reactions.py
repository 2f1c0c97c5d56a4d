"""Reactions and notification preferences as reductions of an event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foyer.operators.search import numbered

GRACE_SECONDS = 5


ACTIONS = ("toggle", "add", "remove", "archive", "unarchive", "undo")


def current(log: DataFrame) -> DataFrame:
    """property_id, type, archived, created_at of a log(event_id, property_id, action, type, ts).

    toggle: the same type again takes the reaction back, another one replaces it.
    add: the same type again only ends an archived like's archiving.  remove: takes back
    a reaction of that type.  archive and unarchive: likes only.  undo: takes back a
    dislike set at most GRACE_SECONDS before.  A new or changed reaction isn't
    archived and is created at its action's time.  A property's actions are folded in
    the order of ts, then event_id, in the JVM; other actions are passed over.
    """
    own = log.filter(F.col("action").isin(*ACTIONS))
    grouped = own.groupBy("property_id").agg(F.array_sort(F.collect_list(F.struct(F.col("ts").cast("timestamp").alias("ts"), "event_id", "action", "type"))).alias("log"))
    state = "struct<type:string,archived:boolean,created_at:timestamp>"
    make = lambda t, archived, at: F.struct(t.alias("type"), archived.alias("archived"), at.alias("created_at"))

    def step(s, x):
        none, same, like = F.lit(None).cast(state), s["type"].eqNullSafe(x["type"]), F.coalesce(s["type"] == "like", F.lit(False))
        new, is_ = make(x["type"], F.lit(False), x["ts"]), lambda a: x["action"] == a
        with_mark = lambda archived: make(s["type"], F.lit(archived), s["created_at"])
        fresh = F.unix_micros(x["ts"]) - F.unix_micros(s["created_at"]) <= GRACE_SECONDS * 1_000_000
        return (
            F.when(is_("toggle"), F.when(same, none).otherwise(new))
            .when(is_("add"), F.when(~same, new).when(like, with_mark(False)).otherwise(s))
            .when(is_("remove"), F.when(same, none).otherwise(s))
            .when(is_("archive") & like, with_mark(True))
            .when(is_("unarchive") & like, with_mark(False))
            .when(is_("undo") & F.coalesce((s["type"] == "dislike") & fresh, F.lit(False)), none)
            .otherwise(s)
        )

    done = grouped.withColumn("s", F.aggregate("log", F.lit(None).cast(state), step))
    return done.filter("s.type is not null").select("property_id", "s.type", "s.archived", "s.created_at")


def latest(log: DataFrame) -> DataFrame:
    """property_id, type of a log(property_id, type, ts): the reactions of a property's latest time, all of them if several share it."""
    last = log.groupBy("property_id").agg(F.max("ts").alias("_last"))
    return log.join(last, "property_id").filter(F.col("ts") == F.col("_last")).select("property_id", "type")


def counts(reactions: DataFrame, archived: bool = False) -> DataFrame:
    own = reactions if archived else reactions.filter("not archived")
    return own.agg(F.count_if(F.col("type") == "like").alias("likes"), F.count_if(F.col("type") == "dislike").alias("dislikes"))


def listing_page(properties: DataFrame, reactions: DataFrame, kind: str, most: int = 200) -> DataFrame:
    """Properties with a reaction of a kind that isn't archived, the newest first, with their places."""
    own = reactions.filter((F.col("type") == kind) & ~F.col("archived"))
    order = [F.desc("created_at"), F.desc("id")]
    return numbered(properties.join(own.select(F.col("property_id").alias("_rid"), "created_at"), F.col("id") == F.col("_rid")).orderBy(*order).limit(most), order).drop("_rid")


def notify_household(preferences: DataFrame) -> DataFrame:
    """True if someone wants notices, or nobody has said anything."""
    return preferences.agg(((F.count_if("enabled") > 0) | (F.count("*") == 0)).alias("send"))


def notices(rows: DataFrame, most: int = 5) -> DataFrame:
    """The first rows by rank, and one that says how many more there are."""
    first = rows.orderBy("rank").limit(most).select(F.col("rank").cast("long").alias("rank"), "title")
    more = rows.agg(F.count("*").alias("n")).filter(F.col("n") > most).select(F.lit(most + 1).cast("long").alias("rank"), F.concat(F.lit("+"), (F.col("n") - most).cast("string")).alias("title"))
    return first.unionByName(more)
