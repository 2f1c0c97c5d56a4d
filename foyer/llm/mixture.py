"""Mixing sources to target weights, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foyer.llm.common import keyed, shielded, store

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes(source, source_size) with target: what the mix takes of each source.

    Sources by code point, null last, weigh weights in turn and share ``share`` times
    the sum of all sizes.  No target is above ``most`` times its source's size; what
    a source can't take goes to the others by weight.  A common level solves that:
    target = min(most * size, level * weight), and a source is full if the sum of
    these minima at its own level stays below the total.
    """
    everywhere = W.partitionBy()
    order = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    listed = F.array(*map(F.lit, map(float, weights)))
    ranked = sizes.select("source", "source_size", F.element_at(listed, ((order - 1) % len(weights) + 1).cast("int")).alias("weight"))
    ranked = ranked.withColumn("most", F.col("source_size") * float(most)).withColumn("total", F.sum("source_size").over(everywhere) * float(share))
    by_level = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing))
    full = ranked.withColumn("full", before + F.col("most") / F.col("weight") * after < F.col("total"))
    rest = F.first("total").over(everywhere) - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(everywhere)
    level = rest / F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everywhere)
    return full.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.least("most", level * F.col("weight")))).select("source", "source_size", "target")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 10, carry: tuple[str, ...] = (), key: str | None = None) -> DataFrame:
    """docs(doc_id, source, text) as doc_id, source, size, source_size, target, taken, and the columns of carry.

    taken: the words that the mix takes of the document, repeats counted.  Documents
    of a source stand in the order of a seeded hash; each whole epoch takes all of
    them, and the rest of the budget is cut from the front of the order, so the
    last document may give a part of its words.  Each source gives its target
    rounded down.  Null text has no words; null is a source of its own.  Rows that share
    a doc_id, or have none, are documents of their own; equal rows may take each other's
    place.  key: a column with a number of each row's own, if docs has one.  An empty
    table gives an empty result.

    A source's order is split by ranges of the hash: sums of the ranges, a running
    sum over these, then running sums inside each range.  So no task holds a source.
    """
    spark = docs.sparkSession
    bits = max(6, (8 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length())
    own_key = key or "_key"
    numbered = docs if key else keyed(docs.select("doc_id", "source", "text", *carry))
    drawn = F.xxhash64(own_key, F.lit(seed))  # of the row, not the doc_id: rows that share one are spread over the ranges
    slim = store(numbered.select("doc_id", "source", *carry, word_count("text").alias("size"), drawn.alias("key"), F.shiftright(drawn, 64 - bits).alias("range")), "mixture")
    ranges = slim.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    in_source = W.partitionBy("source").orderBy("range")
    ranges = ranges.withColumn("before", F.sum("in_range").over(in_source) - F.col("in_range"))
    sizes = ranges.groupBy("source").agg(F.sum("in_range").alias("source_size"))
    targets = source_targets(sizes, weights, share, most)
    own = [F.coalesce("source", F.lit("")).alias("own"), F.col("source").isNull().alias("none")]
    placed = ranges.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select(F.coalesce("r.source", F.lit("")).alias("own"), F.col("r.source").isNull().alias("none"), "range", "before", "source_size", "target")
    rows = slim.select("doc_id", "source", "size", "key", "range", *carry, *own).join(placed, ["own", "none", "range"])
    order = W.partitionBy("own", "none", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    at = F.col("before") + F.sum("size").over(order) - F.col("size")
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    part = F.greatest(F.lit(0), F.least("size", budget - epochs * F.col("source_size") - F.col("at")))
    return rows.withColumn("at", at).select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"), *carry)


def mixed_documents(docs: DataFrame, **kwargs) -> DataFrame:
    """The documents of the mix, with docs' columns: one row for each time that it takes a document.

    A document that the budget cuts keeps its first words, with the white space between them.
    """
    inner, named = shielded(docs, ("doc_id", "source", "text"))
    own = keyed(inner)
    plan = mix(own, carry=("_key",), key="_key", **kwargs).filter("taken > 0").select("_key", F.col("size").alias("_size"), "taken")
    epochs = own.join(plan, "_key").withColumn("_left", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.col("taken") - 1) / F.col("_size"))), lambda k: F.col("taken") - k * F.col("_size"))))
    # each word with the white space before it; no counted group, which Java matches by recursion
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), F.col("_left").cast("int")), "")
    return named(epochs.withColumn("text", F.when(F.col("_left") >= F.col("_size"), F.col("text")).otherwise(cut)).select(*inner.columns))
