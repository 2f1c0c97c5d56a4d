"""Reproducible shuffle and sharding by a Feistel permutation of global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foyer.llm.common import mix64, number_rows

ROUNDS = 6


def permute(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The place of each row number under a keyed permutation of 0..n-1.

    A Feistel network permutes 0..4**h-1, the least such range that holds n; a
    place outside 0..n-1 is permuted again until it is inside (cycle walking).
    """
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    low = np.uint64((1 << int(half)) - 1)
    keys = [np.uint64(int.from_bytes(np.random.Philox(key=seed + k).random_raw(1).tobytes(), "little")) for k in range(ROUNDS)]
    place = rows.astype("uint64")
    todo = np.arange(len(place))
    while len(todo):
        left, right = place[todo] >> half, place[todo] & low
        for key in keys:
            left, right = right, left ^ (mix64(right + key) & low)
        place[todo] = left << half | right
        todo = todo[place[todo] >= n]
    return place.astype("int64")


def shard(docs: DataFrame, shards: int = 40, seed: int = 4) -> DataFrame:
    """docs(doc_id, text) as doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law `rows`: a document's place p under the permutation of all row numbers gives
    shard p mod shards and slot p div shards, so counts differ by one at most and
    any reader can compute where row k went.  size: UTF-8 bytes plus 16.  Null text
    counts as empty.  Rows are numbered by doc_id (null first), then size and
    checksum; rows equal in these are alike in the result.  An empty table gives an
    empty result.
    """
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    numbered, n = number_rows(slim, "doc_id", "size", "text_crc32")

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), n, seed))

    placed = numbered.withColumn("place", place("row_no"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def row_place(row_no: int, n: int, shards: int = 40, seed: int = 4) -> tuple[int, int]:
    """Shard and slot of one row, without the table."""
    p = int(permute(np.array([row_no]), n, seed)[0])
    return p % shards, p // shards
