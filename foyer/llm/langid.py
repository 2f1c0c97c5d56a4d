"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foyer.llm.common import batch, bound_batches, by_bytes

#: Lengths of n-grams, and bits of the buckets that they are hashed to.
GRAMS, BITS = (1, 2, 3, 4), 16
#: Documents of each language that the classifier is fitted on (of more, a hash draws about so many).
SAMPLE = 10_000
#: Bytes that the matrix of log probabilities may have; more languages get fewer buckets, down to 2**LEAST_BITS.
MODEL_BYTES, LEAST_BITS = 256 << 20, 10
#: Characters that are looked at in one step, and the fixed point of log probabilities: sums of whole numbers don't depend on their order.
STEP, POINT = 1 << 19, 1 << 20
#: Tasks that count n-grams, and slices of a language's counts that are summed on their own.
TASKS, SLICES = 32, 16
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), "bool", 0x110000)


def code_points(text: str) -> np.ndarray:
    """The lower-cased text between spaces; each run of other characters than letters is one space."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "uint32").astype("uint64")
    points[~_letters()[points]] = 32
    keep = points != 32
    keep[1:] |= points[:-1] != 32
    keep[0] = True
    return points[keep]


def parts_of(texts: list[str]) -> Iterator[tuple[int, str]]:
    """The texts with their positions; a text longer than STEP in parts, cut at white space where there is some."""
    for k, text in enumerate(texts):
        at = 0
        while at < len(text) or not at:
            end = at + STEP
            if end < len(text):
                end = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end)) if " " in text[at + 1 : end] or "\n" in text[at + 1 : end] else end
            yield k, text[at:end]
            at = end


def grams(texts: list[str], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n the buckets of the texts' n-grams, text by text, and how many each text has.

    A lone space is no n-gram, so a text without letters has none.
    """
    points = [code_points(t) for t in texts]
    sizes = np.fromiter(map(len, points), "int64", len(points))
    joined = np.concatenate(points) if points else np.zeros(0, "uint64")
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(joined))  # characters from here to the text's end
    row, value = np.repeat(np.arange(len(sizes)), sizes), np.zeros(len(joined), "uint64")
    for n in range(1, max(GRAMS) + 1):
        last = joined[n - 1 :]
        value = value[: len(last)] * np.uint64(0x9E3779B97F4A7C15) + last + np.uint64(1)
        if n in GRAMS:
            keep = last != 32 if n == 1 else left[: len(last)] >= n
            mixed = (value[keep] ^ (value[keep] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            yield (mixed >> np.uint64(64 - bits)).astype("int64"), np.bincount(row[: len(last)][keep], minlength=len(sizes))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """docs(doc_id, text, lang) without nulls in text and lang; the classifier of its languages.

    It is fitted on about ``sample`` documents of each language: those whose hash
    is below a share, so reruns agree.  Priors are the shares of all documents.
    Counts are summed by slices, a row for each task, and reach the driver as one
    matrix of at most MODEL_BYTES.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    most = MODEL_BYTES >> (LEAST_BITS + 3)
    rows = docs.groupBy("lang").count().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a model of more than {most} languages has no place in {MODEL_BYTES} bytes")
    langs = sorted(r.lang for r in rows)
    bits = BITS
    while bits > LEAST_BITS and len(langs) << (bits + 3) > MODEL_BYTES:
        bits -= 1
    if not langs:
        return Model([], np.zeros((0, 1 << bits), "int64"), np.zeros(0, "int64"), bits)
    shares = spark.createDataFrame([(r.lang, sample / r["count"]) for r in rows], "lang string, share double")
    drawn = docs.join(F.broadcast(shares), "lang").filter((F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(12)), 11) / float(1 << 53)) < F.col("share"))
    width, at = (1 << bits) // SLICES, {lang: k for k, lang in enumerate(langs)}
    counted = pa.schema([("lang", pa.string()), ("slice", pa.int32()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for b in batches:
            names = b.column("lang").to_pylist()
            for part in by_bytes(list(parts_of(b.column("text").to_pylist())), lambda x: len(x[1]), STEP):
                of = np.array([at[names[k]] for k, _ in part])
                for buckets, sizes in grams([t for _, t in part], bits):
                    owner = np.repeat(of, sizes)
                    for k in np.unique(of):
                        totals.setdefault(langs[k], np.zeros(1 << bits, "int64"))[:] += np.bincount(buckets[owner == k], minlength=1 << bits)
        for lang, total in totals.items():
            yield batch(counted, [lang] * SLICES, range(SLICES), [total[k * width : (k + 1) * width].tobytes() for k in range(SLICES)])

    def add(key: tuple, t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "int64") for x in t["counts"].to_pylist())
        return pa.Table.from_batches([batch(counted, [key[0].as_py()], [key[1].as_py()], [total.tobytes()])])

    ddl = "lang string, slice int, counts binary"
    tables = drawn.select("lang", "text").repartition(TASKS).mapInArrow(count, ddl).groupBy("lang", "slice").applyInArrow(add, ddl).collect()
    counts = np.zeros((len(langs), 1 << bits), "int64")
    for r in tables:
        counts[at[r.lang], r.slice * width : (r.slice + 1) * width] = np.frombuffer(r.counts, "int64")
    logs = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * (1 << bits)))
    priors = np.array([r["count"] for r in sorted(rows, key=lambda r: r.lang)], "float64")
    return Model(langs, np.rint(logs * POINT).astype("int64"), np.rint(np.log(priors / priors.sum()) * POINT).astype("int64"), bits)


class Model:
    """Languages, fixed-point log probabilities of buckets (language, bucket), and log priors."""

    def __init__(self, langs: list[str], logs: np.ndarray, priors: np.ndarray, bits: int):
        self.langs, self.logs, self.priors, self.bits = langs, logs, priors, bits

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The most probable language of each text and its posterior; ``und`` and 0 for texts without letters."""
        sums, seen = np.zeros((len(texts), len(self.langs)), "int64"), np.zeros(len(texts), "int64")
        for part in by_bytes(list(parts_of(texts)), lambda x: len(x[1]), STEP):
            whose = np.array([k for k, _ in part])
            for buckets, sizes in grams([t for _, t in part], self.bits):  # sparse rows: the buckets of each part, in a run
                np.add.at(seen, whose, sizes)
                full = np.flatnonzero(sizes)
                if len(full):
                    starts = (np.cumsum(sizes) - sizes)[full]
                    for k, row in enumerate(self.logs):
                        np.add.at(sums[:, k], whose[full], np.add.reduceat(row[buckets], starts))
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        sums += self.priors
        best = sums.argmax(axis=1)
        score = 1 / np.exp((sums - sums.max(axis=1, keepdims=True)) / POINT).sum(axis=1)
        return [self.langs[k] if n else UNKNOWN for k, n in zip(best, seen)], np.where(seen > 0, score, 0.0)


def held_out(doc_id: str | Column, folds: int = 5) -> Column:
    """Documents that nothing is learned from: the crc32 of their doc_id as text is divisible by folds; null counts as empty."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def identify(docs: DataFrame, folds: int = 5, sample: int = SAMPLE) -> DataFrame:
    """docs(doc_id, text, lang) as doc_id, held_out, lang_pred, score.

    lang_pred is the language of the largest posterior under a naive Bayes model of
    character n-grams, fitted on the documents that aren't held out and have a text
    and a lang; score is that posterior.  Equal texts have equal predictions.  Null
    texts and those without a letter get ``und`` and 0, and so does every text if
    there is nothing to learn from.  Repeated rows stay repeated; a null doc_id is
    held out.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id", folds))
    model = fit(own.filter("not held_out and text is not null and lang is not null").select("doc_id", "text", "lang"), sample)
    shared = spark.sparkContext.broadcast(model)  # at most MODEL_BYTES
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(schema, b.column("doc_id"), b.column("held_out"), *shared.value.predict(b.column("text").to_pylist()))

    return own.select("doc_id", "held_out", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
