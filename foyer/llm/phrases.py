"""Document fingerprints by locally consistent parsing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foyer.llm.common import SpanHash, bound_batches, by_bytes, mix64, store

#: Levels of phrases, slots of a fingerprint, bytes of text in one step.
LEVELS, SLOTS, STEP = 3, 64, 1 << 19


def tossed(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6 in which neighbors differ: deterministic coin tossing, four rounds.

    names: symbols in which neighbors of a text differ; first: true where a text
    starts.  A round labels a symbol with the place and value of the lowest bit in
    which it differs from the symbol before it; a label so depends on four symbols
    to its left only.
    """
    for _ in range(4):
        before = np.empty_like(names)
        before[1:] = names[:-1]
        before[first] = names[first] ^ names.dtype.type(1)
        diff = names ^ before
        low = diff & (~diff + names.dtype.type(1))
        label = np.bitwise_count(low - names.dtype.type(1)).astype("u1")
        label <<= np.uint8(1)
        label |= (names & low) != 0
        names = label
    return names


def parse(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level: names of phrases and where texts start.

    Runs of equal symbols become one symbol; then phrases start at texts' starts and
    at local maxima of the tossed labels.  A phrase's name is a hash of its symbols, so
    equal substrings have the same phrases but for a few at their ends.
    """
    keep = np.concatenate([[True], (names[1:] != names[:-1]) | first[1:]])
    at = np.flatnonzero(keep)
    symbols = names[at]
    run = np.diff(np.append(at, len(names)))
    starts = first[at]
    label = tossed(symbols, starts)
    peak = np.zeros(len(at), bool)
    peak[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~starts[2:]
    peak |= starts
    begin = np.flatnonzero(peak)
    wide = symbols.astype("uint64") + np.uint64(1)
    if (run > 1).any():
        wide = np.where(run > 1, mix64(wide * np.uint64(0xA0761D6478BD642F) + run.astype("uint64")), wide)
    return SpanHash(wide)(begin, np.append(begin[1:], len(at))), starts[begin]


def sketches(texts: list[bytes], levels: int = LEVELS, slots: int = SLOTS) -> np.ndarray:
    """One row of slots for each text: the least hash of each class of phrase names, in 16 bits; 0 for none.

    Names of all levels count; an empty text has no names.  A quarter of the slots
    belongs to level 1, the rest to the levels above, which hold longer phrases.
    """
    found = np.full((len(texts), slots), np.uint64(0xFFFFFFFFFFFFFFFF))
    lengths = np.array([len(t) for t in texts])
    names = np.frombuffer(b"".join(texts), "u1")
    first = np.zeros(len(names), bool)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    which = np.flatnonzero(lengths)
    for level in range(1, levels + 1):
        if not len(names):
            break
        names, first = parse(names, first)
        own = mix64(names + np.uint64(level))
        quarter = slots // 4
        slot = own % np.uint64(quarter) if level == 1 else own % np.uint64(slots - quarter) + np.uint64(quarter)
        np.minimum.at(found, (which[np.cumsum(first) - 1], slot.astype("int64")), own)
    return np.where(found == np.uint64(0xFFFFFFFFFFFFFFFF), 0, mix64(found) % np.uint64(65535) + np.uint64(1)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots among those that either has; 1 for two empty fingerprints."""
    either = ((a != 0) | (b != 0)).sum(axis=1)
    same = ((a == b) & (a != 0)).sum(axis=1)
    return np.where(either == 0, 1.0, same / np.maximum(either, 1))


def edited(text: str, other: str) -> str:
    """The last third of text replaced by as many first characters of other."""
    k = len(text) // 3
    return text[: len(text) - k] + other[:k]


def compare_with_next(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with each text's fingerprint and its likeness to an edited text and to the next document.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.  Next is the document with the next smaller doc_id (after the last, the
    first); rows that share one stand by a hash of their text, null comes last.  Null
    text counts as empty.  An empty table gives an empty result.

    The texts are stored, compressed, in ranges of that order; the first document of a
    range also goes to the range before it, where it is the last one's next.  So no task
    needs another's rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))

    def shrink(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in it:
            yield b.set_column(b.schema.get_field_index("text"), "text", pa.array([z.compress(t) for t in b.column("text").to_pylist()], pa.binary()))

    small = own.withColumn("text", F.col("text").cast("binary")).mapInArrow(shrink, "doc_id long, text binary, tie long")
    order = [F.desc_nulls_last("doc_id"), F.desc("tie")]
    dealt = store(small.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()), "ranges")
    # a row for each range: their number is that of shuffle partitions
    tops = dealt.groupBy("range").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")).alias("top"))
    by_range = W.orderBy("range")
    before = F.lag("range").over(by_range)
    heads = tops.select(F.coalesce(before, F.max("range").over(W.partitionBy())).alias("target"), F.when(before.isNull(), 2).otherwise(1).alias("copy"), F.col("top.doc_id").alias("id"), F.col("top.tie").alias("id_tie"), F.col("range").alias("own_range"))
    again = dealt.join(F.broadcast(heads), (F.col("range") == F.col("own_range")) & F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tie") == F.col("id_tie"))).select("doc_id", "text", "tie", F.col("target").alias("range"), "copy")
    both = dealt.withColumn("copy", F.lit(0)).unionByName(again)
    sorted_ = both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "range").sortWithinPartitions("range", "copy", *order)
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        held: list[tuple] = []  # rows whose next is still to come: the last one
        for b in it:
            columns = [b.column(c).to_pylist() for c in ("doc_id", "range", "copy", "text")]
            for part in by_bytes(list(zip(*columns)), lambda r: 3 * len(r[3]), STEP):
                rows = held + [(*r[:3], z.decompress(r[3])) for r in part]
                held = rows[-1:]
                pairs = [(a, n) for a, n in zip(rows, rows[1:]) if a[2] == 0 and a[1] == n[1]]
                if not pairs:
                    continue
                text = [a[3].decode() for a, _ in pairs]
                new = [edited(t, n[3].decode()).encode() for t, (_, n) in zip(text, pairs)]
                all_ = sketches([r[3] for r in rows] + new)
                at = [k for k, (a, n) in enumerate(zip(rows, rows[1:])) if a[2] == 0 and a[1] == n[1]]
                one, two, next_ = all_[at], all_[len(rows) :], all_[np.array(at) + 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(([a[0] for a, _ in pairs], list(map(len, text)), [hashlib.sha256(e).hexdigest() for e in new], [x.tobytes().hex() for x in one], [x.tobytes().hex() for x in two], likeness(one, two), likeness(one, next_)), schema)],
                    schema=schema,
                )

    return sorted_.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as doc_id, fingerprint; null text counts as empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for rows in by_bytes(list(zip(*(c.to_pylist() for c in b.columns))), lambda r: len(r[1]), STEP):
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([x.tobytes().hex() for x in sketches([r[1] for r in rows])])], schema=schema)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")
