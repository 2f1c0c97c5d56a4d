"""An index of texts by trigrams: postings lead to candidates, whose texts are then read and verified."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foyer.functions.scalars import contains_ascii_ci
from foyer.session import spread
from foyer.sources.versions import Store, bucket

GRAM = 3
#: Texts whose postings are one batch of rows.
TEXTS = 1000
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text: str) -> set[str]:
    """The distinct trigrams of a text in which A-Z are small."""
    text = text.translate(_FOLD)
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


def _coded(column: str = "gram"):
    return F.pmod(F.xxhash64(column), F.lit(1 << 40))


def postings(texts: DataFrame) -> DataFrame:
    """texts(id, text) as gram, id, code: a row for each distinct trigram of each text; code: what gram is cut by."""
    schema = pa.schema([("gram", pa.string()), ("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            found, ids = [], []
            for id_, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                own = sorted(grams(text))
                found += own
                ids += [id_] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(ids, pa.int64())], schema=schema)

    return spread(texts.filter("text is not null").select(F.col("id").cast("long"), "text"), "id").mapInArrow(run, "gram string, id long").withColumn("code", _coded())


class TextIndex:
    """Texts by id and the postings of their trigrams, as tables of a Store.

    Each batch adds a segment of postings and writes the buckets of texts that it meets.
    Postings of a text that has changed stay: they can only lead to a candidate whose text no
    longer holds what is asked, and every candidate is verified.  compact() drops them.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.store = Store(spark, root, {}, buckets)

    def _segments(self, number: int) -> list[str]:
        names = self.store.entries(number).select("name").distinct().collect()
        return sorted(r.name for r in names if r.name.startswith("postings"))

    def _publish(self, tables: dict[str, DataFrame], touched: dict[str, DataFrame] | None, base: int) -> int:
        self.store.keys |= {name: "id" if name == "texts" else "code" for name in tables}
        return self.store.publish(tables, touched, base)

    def add(self, batch: DataFrame) -> int:
        """Takes in batch(id, text), ids distinct: new texts, and other ones for known ids (null: the text is gone)."""
        base = self.store.sequence()
        own = batch.select(F.col("id").cast("long"), "text")
        texts, touched = own, None
        if base:
            texts, touched = self.store.read("texts", base).join(own.select("id"), "id", "left_anti").unionByName(own), {"texts": own.select("id")}
        return self._publish({"texts": texts, f"postings-{base:010d}": postings(own)}, touched, base)

    def compact(self) -> int:
        """One segment again, with the postings of the present texts only."""
        base = self.store.sequence()
        return self._publish({name: postings(self.store.read("texts", base)) if k == 0 else self.store.read(name, base).limit(0) for k, name in enumerate(self._segments(base))}, None, base)

    def candidates(self, needle: str, number: int | None = None) -> DataFrame:
        """id: the texts that have, or once had, all trigrams of what is asked.  Only the buckets of these are read."""
        number = self.store.sequence() if number is None else number
        asked = sorted(grams(needle))
        if not asked:
            raise ValueError(f"an index of trigrams finds texts of {GRAM} characters or more")
        spark = self.store.spark
        coded = spark.createDataFrame([(g,) for g in asked], "gram string").select("gram", _coded().alias("code"))
        only = {r[0] for r in coded.select(bucket("code", self.store.buckets)).collect()}  # a row for each trigram asked
        found = None
        for name in self._segments(number):
            own = self.store.read(name, number, only).filter(F.col("gram").isin(asked)).select("gram", "id")
            found = own if found is None else found.unionByName(own)
        return found.distinct().groupBy("id").count().filter(F.col("count") == len(asked)).select("id")

    def search(self, needle: str) -> DataFrame:
        """id: the texts that contain it, where only ASCII letters ignore case."""
        number = self.store.sequence()
        near = self.candidates(needle, number).cache()
        only = {r[0] for r in near.select(bucket("id", self.store.buckets)).distinct().collect()}  # buckets at most
        texts = self.store.read("texts", number, only)
        return texts.join(near, "id", "left_semi").filter(contains_ascii_ci(F.col("text"), needle)).select("id")
