"""Photos that look alike."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foyer.functions.scalars import hex_hamming, photo_key
from foyer.session import kept
from foyer.sources.versions import Store

#: Parts of a 64-bit look; looks within MOST bits agree in one part but for MOST / PARTS bits.
PARTS, MOST = 4, 8
_BITS = 64 // PARTS


def near_looks(rows: DataFrame, id_: str, look: str, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of 64-bit looks in 16 hex digits.

    members: each row with same_as, the least id that has its look.  pairs: a < b and
    bits of different looks, each by that id, that differ in ``most`` bits at most.
    Equal looks never meet, so a picture that a third of all rows have is one row here.
    Of two near looks one of PARTS parts differs in most / PARTS bits at most: the parts
    of one side are listed with all that lie so near, and the join asks for equal ones.
    """
    own = rows.select(F.col(id_).alias("_id"), F.lower(look).alias("_look")).filter(F.length("_look") == 16)
    first = own.groupBy("_look").agg(F.min("_id").alias("_first"))
    members = own.join(first, "_look").select(F.col("_id").alias(id_), F.col("_first").alias("same_as"))
    looks = first.select(F.col("_first").alias("id"), F.col("_look").alias("look"))
    pairs = _met(looks, looks, most).filter("a < b")
    return pairs.select("a", "b", "bits").distinct(), members


def _parts(looks: DataFrame) -> DataFrame:
    """looks(id, look) with k and v, each of their parts."""
    parts = F.array(*(F.struct(F.lit(k).alias("k"), F.conv(F.substring("look", 1 + 4 * k, 4), 16, 10).cast("int").alias("v")) for k in range(PARTS)))
    return looks.withColumn("p", F.explode(parts)).select("id", "look", "p.k", "p.v")


def _met(probing: DataFrame, table: DataFrame, most: int) -> DataFrame:
    """a, la, b, lb, bits: looks of probing and table that differ in ``most`` bits at most; a pair may come several times."""
    near = [sum(1 << b for b in flips) for n in range(most // PARTS + 1) for flips in itertools.combinations(range(_BITS), n)]
    probes = _parts(probing).select(F.col("id").alias("a"), F.col("look").alias("la"), "k", F.explode(F.transform(F.array(*map(F.lit, near)), lambda m: F.col("v").bitwiseXOR(m))).alias("v"))
    rows = _parts(table).select(F.col("id").alias("b"), F.col("look").alias("lb"), "k", "v")
    return probes.join(rows, ["k", "v"]).withColumn("bits", hex_hamming(F.col("la"), F.col("lb"))).filter(F.col("bits") <= most)


class LookIndex:
    """Looks of pictures and the pairs of near ones, as tables of a Store that batches extend.

    A batch's looks that aren't known yet are probed against the stored ones and each other,
    so a batch costs what it brings; pairs are kept by look and told by the least id that
    has it, which a later batch may lower.  Buckets are cut by a look's leading digits.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, most: int = MOST):
        self.store, self.most = Store(spark, root, {"looks": "code", "pairs": "code"}, buckets), most

    def add(self, rows: DataFrame, id_: str, look: str) -> int:
        """Takes in rows with 64-bit looks in 16 hex digits; other rows are left alone."""
        base = self.store.sequence()
        code = lambda c: F.conv(F.substring(c, 1, 6), 16, 10).cast("long")
        own = kept(rows.select(F.col(id_).cast("long").alias("id"), F.lower(look).alias("look")).filter(F.length("look") == 16).groupBy("look").agg(F.min("id").alias("id")).withColumn("code", code("look")))
        old = self.store.read("looks", base) if base else own.limit(0)
        every = kept(old.unionByName(own.select(*old.columns)).groupBy("look", "code").agg(F.min("id").alias("id")))
        fresh = kept(own.join(old.select("look"), "look", "left_anti"))
        met = _met(fresh.select("id", "look"), every.select("id", "look"), self.most).filter("la <> lb")
        new = met.select(F.least("la", "lb").alias("one"), F.greatest("la", "lb").alias("two"), "bits").distinct().withColumn("code", code("one"))
        touched = {"looks": own.select("code")}
        if base:
            new = kept(new)
            touched["pairs"] = new.select("code")
            new = self.store.read("pairs", base).unionByName(new)
        return self.store.publish({"looks": every, "pairs": new}, touched if base else None, base)

    def pairs(self) -> DataFrame:
        """a < b and bits of near looks, each by the least id that has it."""
        number = self.store.sequence()
        looks = self.store.read("looks", number)
        named = self.store.read("pairs", number).join(looks.select(F.col("look").alias("one"), F.col("id").alias("x")), "one").join(looks.select(F.col("look").alias("two"), F.col("id").alias("y")), "two")
        return named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "bits")


def unsyndicated(rows: DataFrame, blocked: DataFrame, urls: str = "image_urls", id_: str = "id") -> DataFrame:
    """rows with urls without those whose key is in blocked(photo), in their order, and image_url, the first that is left.

    A row that keeps none has null.  blocked is what stats.overused_photos() gives; each
    url meets it by its key, so neither table is held whole.
    """
    each = rows.select(F.col(id_).alias("_id"), F.posexplode(urls).alias("_at", "_url"))
    good = each.join(blocked.select(F.col("photo").alias("_photo")), photo_key(F.trim("_url")) == F.col("_photo"), "left_anti")
    left = good.groupBy("_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_url"))), lambda x: x["_url"]).alias("_kept"))
    joined = rows.join(left, F.col(id_) == F.col("_id"), "left")
    return joined.withColumns({urls: F.col("_kept"), "image_url": F.nullif(F.trim(F.get("_kept", F.lit(0))), F.lit(""))}).drop("_id", "_kept")
