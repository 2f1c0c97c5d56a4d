"""Preference formatting: prompt, chosen and rejected completions with loss masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def adjacent_pairs(turns: DataFrame) -> DataFrame:
    """pair_id, chosen_id, rejected_id: conversation 2k is chosen over conversation 2k + 1."""
    ids = turns.filter("conv_id is not null").select("conv_id").distinct()
    pair = F.floor(F.col("conv_id") / 2)
    one = F.when(F.col("conv_id") % 2 == 0, F.col("conv_id"))
    two = F.when(F.col("conv_id") % 2 != 0, F.col("conv_id"))
    return ids.groupBy(pair.alias("pair_id")).agg(F.max(one).alias("chosen_id"), F.max(two).alias("rejected_id")).filter("chosen_id is not null and rejected_id is not null")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def format_preferences(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row for each pair of conversations of turns(conv_id, turn, role, text).

    Turns stand in the order of turn, role, text; null role and text count as
    empty.  The longest common prefix of turns (role and text equal) is rendered
    once as prompt, the rest of each as its completion.  chosen_mask and
    rejected_mask list the spans [start, end) of characters of the completion that
    carry loss: texts of assistant turns with their end mark.  Equal conversations
    give empty completions.  Pairs whose conversation has no turns are left out.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = clean.select("conv_id", F.row_number().over(order).alias("at"), "role", "text")
    sides = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("chosen_id").alias("conv_id")), F.struct(F.lit(2).alias("side"), F.col("rejected_id").alias("conv_id")))).alias("x")).select("pair_id", "x.side", "x.conv_id")
    both = sides.join(placed, "conv_id").groupBy("pair_id", "at").agg(*(F.max(F.when(F.col("side") == s, F.struct("role", "text"))).alias(n) for s, n in ((1, "chosen"), (2, "rejected"))))
    sorted_ = both.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("at", "chosen", "rejected"))).alias("turns"))
    same = F.aggregate("turns", F.lit(0), lambda n, t: F.when((n == t["at"] - 1) & t["chosen"].eqNullSafe(t["rejected"]), n + 1).otherwise(n))

    def text(side: str, keep) -> Column:
        return F.array_join(F.transform(F.filter("turns", lambda t: keep(t) & t[side].isNotNull()), lambda t: rendered(t[side]["role"], t[side]["text"])), "")

    def mask(side: str) -> Column:
        own = F.filter("turns", lambda t: (t["at"] > F.col("n_common")) & t[side].isNotNull())
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))

        def step(s: Column, t: Column) -> Column:
            head = s["at"] + F.length(t[side]["role"]) + 5
            end = head + F.length(t[side]["text"]) + 7
            span = F.struct(head.cast("long").alias("start"), end.cast("long").alias("end"))
            return F.struct((end + 1).cast("long").alias("at"), F.when(t[side]["role"] == "assistant", F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"))

        return F.aggregate(own, start, step)["spans"]

    ready = sorted_.filter(F.exists("turns", lambda t: t["chosen"].isNotNull()) & F.exists("turns", lambda t: t["rejected"].isNotNull())).withColumn("n_common", same)
    after = lambda t: t["at"] > F.col("n_common")
    return ready.select(
        "pair_id",
        "n_common",
        text("chosen", lambda t: t["at"] <= F.col("n_common")).alias("prompt"),
        text("chosen", after).alias("chosen"),
        text("rejected", after).alias("rejected"),
        mask("chosen").alias("chosen_mask"),
        mask("rejected").alias("rejected_mask"),
    )


def mask_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",")
