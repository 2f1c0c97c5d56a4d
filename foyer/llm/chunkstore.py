"""Content-addressed store of token ids.

A store is a folder of three Parquet tables:

stored/kind=chunk  key (sha256 of the id bytes), n (ids), width (bytes of an id), ids.
           A rolling hash over the ids cuts each document where the content says so,
           so equal passages give equal chunks; each is stored once.
recipes    in ascending doc_id order: row, doc_id, start, n_tokens, chunks, lengths,
           root, part.  root is the Merkle root of the document's chunks.
manifest   one row per range of recipes: part, start, n_docs, n_tokens, root over its
           documents' roots.

Reading checks each chunk against its hash, each recipe against its root and the
recipes against the manifest; what doesn't hold fails the job.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foyer.llm.common import batch, bound_batches, by_bytes, drop, mix64, new_path, store
from foyer.llm.tokens import encoder

#: Ids that the rolling hash covers, mean ids of a chunk, fewest and most.
WINDOW, MEAN, LEAST, MOST = 16, 512, 64, 4096
_STEP = np.uint64(0x9E3779B97F4A7C15)


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of ids: where the hash of the WINDOW ids before is 0 modulo MEAN."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    total = np.concatenate([np.zeros(1, "uint64"), np.cumsum(mix64(ids.astype("uint64") + _STEP), dtype="uint64")])
    ends = np.flatnonzero(mix64(total[WINDOW:] - total[:-WINDOW]) % np.uint64(MEAN) == 0) + WINDOW
    found, last = [], 0
    for end in [*ends.tolist(), n]:
        while end - last > MOST:
            last += MOST
            found.append(last)
        if end - last >= LEAST or end == n and end > last:
            found.append(end)
            last = end
    return found


def merkle(leaves: list[bytes]) -> bytes:
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() for i in range(0, len(level), 2)]
    return level[0]


def narrow(ids: np.ndarray) -> tuple[int, bytes]:
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return width, ids.astype(f"<u{width}").tobytes()


def write_store(docs: DataFrame, tokenizer: str, end_id: int, path: str) -> None:
    """Writes docs(doc_id, text) as a store.  Null text counts as empty, so it has the end id; repeated rows stay repeated.

    The ids travel once: encoding, cutting and a shuffle by chunk hash that keeps
    one copy of each chunk (with a partial step before it, so a chunk that a third
    of all documents share doesn't travel as often).
    """
    bound_batches(docs.sparkSession)
    schema = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("chunks", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int32()))])
    end = end_id.to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer)
        met: set[bytes] = set()
        for b in batches:
            for rows in by_bytes(list(zip(*(c.to_pylist() for c in b.columns))), lambda r: len(r[2]), 2 << 20):
                out = []
                for (row, doc_id, _), raw in zip(rows, tokens.encode([r[2] for r in rows])):
                    ids, at, recipe, lengths = np.frombuffer(raw + end, "<u4"), 0, [], []
                    for to in cuts(ids):
                        width, own = narrow(ids[at:to])
                        recipe.append(hashlib.sha256(own).digest())
                        lengths.append(to - at)
                        if recipe[-1] not in met:
                            out.append(("chunk", recipe[-1], None, to - at, width, own, None, None))
                            if len(met) < 200_000:
                                met.add(recipe[-1])
                        at = to
                    out.append(("recipe", row.to_bytes(8, "big"), doc_id, len(ids), None, merkle(recipe), recipe, lengths))
                yield batch(schema, *zip(*out))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        encode, "kind string, key binary, doc_id long, n long, width int, ids binary, chunks array<binary>, lengths array<int>"
    )
    one = rows.groupBy("kind", "key").agg(*(F.first(c).alias(c) for c in ("doc_id", "n", "width", "ids", "chunks", "lengths")))
    one.write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/stored")
    spark = docs.sparkSession
    own = _stored(spark, path, "recipe").select(F.conv(F.hex("key"), 16, 10).cast("long").alias("row"), "doc_id", F.col("n").alias("n_tokens"), "chunks", "lengths", F.col("ids").alias("root"))
    ordered = store(own.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").withColumn("part", F.spark_partition_id()), "ordered")
    # one row per partition: sums before each, then a running sum inside it
    sums = ordered.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs")).orderBy("part").collect()
    before = dict(zip((r["part"] for r in sums), itertools.accumulate((r["n_tokens"] for r in sums), initial=0)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[int, int] = {}
        for b in batches:
            n, part = b.column("n_tokens").to_numpy(), b.column("part").to_numpy(zero_copy_only=False)
            start = np.zeros(len(n), "int64")
            for k in dict.fromkeys(part.tolist()):
                own = part == k
                sums_ = at.get(k, before[k]) + np.cumsum(n[own])
                start[own] = sums_ - n[own]
                at[k] = int(sums_[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(start)], names=[*b.schema.names, "start"])

    placed = ordered.repartition(max(1, len(sums)), "part").sortWithinPartitions("part", "doc_id", "row").mapInArrow(place, f"{', '.join(f'{c} {t}' for c, t in ordered.dtypes)}, start long")
    placed.write.option("compression", "zstd").parquet(f"{path}/recipes")
    drop(ordered)
    part_roots(spark, path).write.parquet(f"{path}/manifest")


_CHUNK = "key binary, n long, width int, ids binary"
_RECIPE = "row long, doc_id long, n_tokens long, chunks array<binary>, lengths array<int>, root binary, part int, start long"
_PART = "part int, start long, n_docs long, n_tokens long, root binary"


def _stored(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of one kind; an empty store has no folder for it, but has its schema."""
    schema = "key binary, doc_id long, n long, width int, ids binary, chunks array<binary>, lengths array<int>, kind string"
    return spark.read.schema(schema).parquet(f"{path}/stored").filter(F.col("kind") == kind)


def part_roots(spark: SparkSession, path: str) -> DataFrame:
    """What the manifest must say of the recipes: part, start, n_docs, n_tokens, root.

    A task folds the roots of one range of recipes: 32 bytes of each document.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "doc_id", "row"])
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "start": [pdf["start"].iloc[0]], "n_docs": [len(pdf)], "n_tokens": [pdf["n_tokens"].sum()], "root": [merkle(list(pdf["root"]))]})

    recipes = spark.read.schema(_RECIPE).parquet(f"{path}/recipes")
    return recipes.select("part", "start", "doc_id", "row", "n_tokens", "root").groupBy("part").applyInPandas(fold, _PART)


def verify_manifest(spark: SparkSession, path: str) -> int:
    """Compares the recipes with the manifest, which has a row for each range; returns the number of documents."""
    manifest = spark.read.schema(_PART).parquet(f"{path}/manifest")
    names = [c.split()[0] for c in _PART.split(", ")]
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"f.{c}")) for c in names]
    joined = manifest.alias("m").join(part_roots(spark, path).alias("f"), F.col("m.part") == F.col("f.part"), "full")
    held = joined.agg(F.coalesce(F.sum("m.n_docs"), F.lit(0)).alias("n"), F.coalesce(F.bool_and(reduce(lambda a, b: a & b, same)), F.lit(True)).alias("holds")).first()
    if not held["holds"]:
        raise ValueError("the recipes do not have the roots of the manifest")
    return held["n"]


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """key, n, width, ids of every stored chunk; a chunk without its hash fails the job."""
    schema = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("width", pa.int32()), ("ids", pa.binary())])

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, width, n, ids in zip(*(b.column(c).to_pylist() for c in ("key", "width", "n", "ids"))):
                if hashlib.sha256(ids).digest() != key or len(ids) != n * width:
                    raise ValueError("a chunk does not have its hash")
            yield b.select(schema.names)

    return _stored(spark, path, "chunk").select("key", "n", "width", "ids").mapInArrow(held, _CHUNK)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """row, doc_id, start, n_tokens, at, key, length, after of the chunks of every recipe.

    at: the chunk's number in its document; after: ids of the document behind it.  A
    recipe without its Merkle root, or with other lengths than n_tokens, fails the job.
    """
    names = ("row", "doc_id", "start", "n_tokens")
    schema = pa.schema([*((c, pa.int64()) for c in names), ("at", pa.int32()), ("key", pa.binary()), ("length", pa.int64()), ("after", pa.int64())])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = [np.array(x, "int64") for x in b.column("lengths").to_pylist()]
            chunks = b.column("chunks").to_pylist()
            for own, n, root, total in zip(chunks, lengths, b.column("root").to_pylist(), b.column("n_tokens").to_pylist()):
                if merkle(own) != root or n.sum() != total or len(own) != len(n):
                    raise ValueError("a recipe does not have its Merkle root")
            count = np.array([len(n) for n in lengths], "int64")
            columns = [np.repeat(b.column(c).to_numpy(zero_copy_only=False), count) if b.column(c).null_count == 0 else [v for v, k in zip(b.column(c).to_pylist(), count) for _ in range(k)] for c in names]
            yield batch(schema, *columns, np.concatenate([np.arange(k) for k in count]), [k for own in chunks for k in own], np.concatenate(lengths), np.concatenate([n.sum() - np.cumsum(n) for n in lengths]))

    recipes = spark.read.schema(_RECIPE).parquet(f"{path}/recipes")
    return recipes.select(*names, "chunks", "lengths", "root").mapInArrow(expand, "row long, doc_id long, start long, n_tokens long, at int, key binary, length long, after long")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (array of long): documents put together again from the store's verified chunks."""

    @F.pandas_udf("array<long>")
    def widen(width: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(i, f"<u{w}").astype("int64") for w, i in zip(width, ids)])

    joined = read_parts(spark, path).join(read_chunks(spark, path), "key", "left").withColumn("ids", F.when(F.col("ids").isNull(), F.raise_error(F.lit("chunks are missing")).cast("binary")).otherwise(F.col("ids"))).withColumn("own", widen("width", "ids"))
    return joined.groupBy("row", "doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("at", "own"))).alias("all")).select("doc_id", "start", F.flatten(F.transform("all", lambda x: x["own"])).alias("ids"))


@lru_cache
def _crc_steps() -> np.ndarray:
    """[k, j, b]: what byte j of a crc32 with value b becomes after 2**k zero bytes (a crc32 is linear in its bits)."""
    one = np.array([zlib.crc32(b"\0", 0) ^ zlib.crc32(b"\0", 1 << i) for i in range(32)], "uint32")

    def tables(bits: np.ndarray) -> np.ndarray:
        out = np.zeros((4, 256), "uint32")
        for j in range(4):
            for i in range(8):
                out[j, (np.arange(256) >> i & 1).astype(bool)] ^= bits[8 * j + i]
        return out

    # crc32(x + 0s) without the constant part: zlib's value starts and ends inverted, which cancels in differences
    steps = [tables(one)]
    for _ in range(40):
        t = steps[-1]
        bits = np.array([1 << i for i in range(32)], "uint32")
        for _ in range(2):
            bits = t[0, bits & 255] ^ t[1, bits >> 8 & 255] ^ t[2, bits >> 16 & 255] ^ t[3, bits >> 24]
        steps.append(tables(bits))
    return np.array(steps)


def crc_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """The part of a text's crc32 that comes from a piece with this crc32 and n_bytes after it; a text's is the xor of its pieces'."""
    crc, steps = crc.astype("uint32"), _crc_steps()
    for k in range(int(n_bytes.max(initial=0)).bit_length()):
        t, own = steps[k], (n_bytes >> k & 1).astype(bool)
        x = crc[own]
        crc[own] = t[0, x & 255] ^ t[1, x >> 8 & 255] ^ t[2, x >> 16 & 255] ^ t[3, x >> 24]
    return crc


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the store's files.

    Each stored chunk is read, checked against its hash and digested once; the
    recipes then combine the chunks' checksums, so no ids travel.
    """
    schema = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("crc", pa.int64())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            width, ids = (b.column(c).to_pylist() for c in ("width", "ids"))
            yield batch(schema, b.column("key").to_pylist(), b.column("n").to_pylist(), [zlib.crc32(np.frombuffer(i, f"<u{w}").astype("<u4").tobytes()) for i, w in zip(ids, width)])

    @F.pandas_udf("long")
    def shifted(crc: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series(crc_shift(crc.to_numpy("int64"), after.to_numpy("int64")).astype("int64"))

    chunks = read_chunks(spark, path).mapInArrow(digest, "key binary, n long, crc long")
    joined = read_parts(spark, path).join(chunks, "key").withColumn("crc", shifted("crc", F.col("after") * 4))
    per_doc = joined.groupBy("row", "doc_id", "start", "n_tokens").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("n").alias("read"))
    n_tokens = F.when(F.col("read") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("chunks are missing")).cast("long"))
    return per_doc.select("doc_id", "start", n_tokens.alias("n_tokens"), "ids_crc32")


def stored_digests(docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Writes docs as a store in the shared folder (or path), verifies its manifest and returns read_digests of it.

    Rows with equal or null doc_id are documents of their own, null first; other
    columns of docs are passed over; an empty table gives an empty store.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_store(docs, tokenizer, end_id, path)
    verify_manifest(spark, path)
    return read_digests(spark, path)
