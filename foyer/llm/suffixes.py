"""Suffix-array deduplication with a logarithmic family of indexes.

The arrays are sparse: of a text they hold the suffixes that its windows choose (one
for each block of windows around an anchor), so that windows that are equal, wherever
they stand, choose equal suffixes.  An array is in the order of its suffixes' first
eight bytes; suffixes that begin alike stand in the order of a 128-bit name of all
their bytes, so equal ones are neighbors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from foyer.llm.common import SpanHash, batch, bound_batches, by_bytes, drop, keyed, mix64, new_path, shielded, store, utf8

#: Bytes of the repeats that are removed; of the grams that choose suffixes; windows of a block around a suffix.
LENGTH, GRAM, BLOCK = 400, 48, 100
#: Bytes of the passages that the report asks for, and of the strings that stand for them.
PASSAGE, PASSAGE_GRAM = 256, 100
#: Batches in which a corpus enters the family.
BATCHES = 4
#: Bytes of text in one step of a task; windows of a longer text come in parts that overlap.
_STEP, _LONG = 1 << 18, 1 << 19


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    rows = -(-len(values) // width)
    padded = np.full(rows * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    table = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def digests(data: bytes, begin: np.ndarray, end: np.ndarray, seeds: np.ndarray | None = None) -> np.ndarray:
    """128-bit hashes of data[begin:end], as two columns of longs."""
    pairs = zip(begin.tolist(), end.tolist())
    found = [xxh3_128_digest(data[i:j]) for i, j in pairs] if seeds is None else [xxh3_128_digest(data[i:j], k) for (i, j), k in zip(pairs, seeds.tolist())]
    return np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)


def suffixes(text: bytes, first: np.ndarray, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> tuple[np.ndarray, ...]:
    """p0, p1, begin, head, name, hull of the chosen suffixes of texts laid end to end.

    first: for each byte the place where its text starts.  A window of ``length``
    bytes is anchored at the gram in it with the least hash (the first of equals), so
    equal windows have equal anchors.  Windows of one anchor are dealt to blocks by
    their distance from it.  A block's suffix begins where the last window of the full
    block would begin and is read for ``length - block + 1`` bytes: all windows of the
    block contain it.  head: its first 8 bytes, in an order that longs keep; name: the
    hash of it; hull: the hash of all bytes of the windows p0..p1 that the text has of
    the block.
    """
    data = np.frombuffer(text, "u1")
    n = len(data)
    if n < length:
        none = np.empty(0, "int64")
        return none, none, none, none, none.reshape(0, 2), none.reshape(0, 2)
    own = SpanHash(data.astype("uint64") + np.uint64(1))
    i = np.arange(n - gram + 1)
    grams = (mix64((own.sums[gram:] - own.sums[:-gram]) * own._inverses[: n - gram + 1]) & np.uint64(0xFFFFFFFFFF000000)) | i.astype("uint64")
    at = (sliding_least(grams, length - gram + 1) & np.uint64(0xFFFFFF)).astype("int64")
    whole = first[: len(at)] == first[length - 1 :]
    part = at - i[: len(at)]
    part //= block
    new = (at[1:] != at[:-1]) | (part[1:] != part[:-1])
    p0 = np.flatnonzero(whole & np.concatenate([[True], ~whole[:-1] | new]))
    p1 = np.flatnonzero(whole & np.concatenate([~whole[1:] | new, [True]]))
    b = part[p0]
    begin = at[p0] - block * b
    head = np.zeros(len(p0), "uint64")
    for k in range(8):
        head = head << np.uint64(8) | data[begin + k].astype("uint64")
    return p0, p1, begin, (head ^ np.uint64(1 << 63)).view("int64"), digests(text, begin, begin + length - block + 1, b), digests(text, p0, p1 + length)


NAME, HULL = ["name_a", "name_b"], ["hull_a", "hull_b"]
SUFFIX = ["head", *NAME]
_ARRAY = "head long, name_a long, name_b long, n long"


def suffix_rows(texts: DataFrame, length: int = LENGTH, batches: int = 1) -> DataFrame:
    """The chosen suffixes of texts(_key, _text): _key, p0, p1, begin, head, name, hull, and a batch by hash of _key."""
    schema = pa.schema([("_key", pa.int64()), *((c, pa.int32()) for c in ("p0", "p1", "begin")), *((c, pa.int64()) for c in (*SUFFIX, *HULL)), ("batch", pa.int32())])

    def sample(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            pieces = [(key, at, text[at : at + _LONG + length - 1]) for key, text in zip(*(c.to_pylist() for c in b.columns)) for at in range(0, max(0, len(text) - length + 1), _LONG)]
            for rows in by_bytes(pieces, lambda r: len(r[2]), _STEP):
                lengths = np.array([len(r[2]) for r in rows])
                offsets = np.cumsum(lengths) - lengths
                p0, p1, begin, head, name, hull = suffixes(b"".join(r[2] for r in rows), np.repeat(offsets, lengths), length)
                which = np.searchsorted(offsets, p0, "right") - 1
                keys = np.array([r[0] for r in rows], "int64")[which]
                shift = np.array([r[1] for r in rows])[which] - offsets[which]
                yield batch(schema, keys, p0 + shift, p1 + shift, begin + shift, head, *name.T, *hull.T, mix64(keys.astype("uint64")) % np.uint64(batches))

    kinds = {pa.int64(): "long", pa.int32(): "int"}
    return texts.select("_key", "_text").mapInArrow(sample, ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))


def sorted_array(rows: DataFrame) -> DataFrame:
    """A suffix array: the distinct suffixes of rows in order, range by range; n counts the places that have one.

    Places are counted before suffixes are sorted, so one that very many texts have is one row of its range.
    """
    return rows.groupBy(*SUFFIX).agg(F.count("*").alias("n")).repartitionByRange(*SUFFIX).sortWithinPartitions(*SUFFIX)


def merge_scan(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two arrays as one, with met: both have the suffix.

    Ranges of both are brought together in order, and a scan compares neighbors: two
    whose common prefix is the whole suffix are one, and a match of the two arrays.
    """
    schema = pa.schema([*((c, pa.int64()) for c in (*SUFFIX, "n")), ("met", pa.bool_())])

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((4, 0), "int64")  # the last suffix; the next batch may begin with its equal
        for b in it:
            rows = np.concatenate([held, np.stack([c.to_numpy() for c in b.columns])], axis=1)
            if not rows.shape[1]:
                continue
            start = np.flatnonzero(np.concatenate([[True], (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)]))
            held = rows[:, start[-1] :]
            count, n = np.diff(start), np.add.reduceat(rows[3], start)[:-1]
            yield batch(schema, *rows[:3, start[:-1]], n, count > 1)
        if held.shape[1]:
            yield batch(schema, *held[:3, :1], held[3:].sum(axis=1), [held.shape[1] > 1])

    both = one.select(*SUFFIX, "n").unionByName(other.select(*SUFFIX, "n"))
    return both.repartitionByRange(*SUFFIX).sortWithinPartitions(*SUFFIX).mapInArrow(scan, f"{_ARRAY}, met boolean")


class IndexFamily:
    """Suffix arrays of what has been inserted, in levels of which each is twice as large as the one before.

    insert() sorts the suffixes of a new batch into an array, scans it against every
    level for suffixes that both have, and adds it to the family: two arrays of one
    level merge into one of the next, as digits of a binary counter do.  So a suffix
    is written again a logarithmic number of times.  The levels are tables under
    ``path``, and the table ``path/levels`` names them: a later session loads the
    family and inserts more.
    """

    _LEVELS = "level int, folder string"

    def __init__(self, spark: SparkSession, path: str, levels: dict[int, str]):
        self.spark, self.path, self.levels = spark, path, levels

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None) -> IndexFamily:
        return cls(spark, path or new_path(spark, "suffix-family"), {})._saved()

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IndexFamily:
        rows = spark.read.schema(cls._LEVELS).parquet(f"{path}/levels").collect()  # a row for each level
        return cls(spark, path, {r["level"]: r["folder"] for r in rows})

    def _saved(self) -> IndexFamily:
        self.spark.createDataFrame(list(self.levels.items()), self._LEVELS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/levels")
        return self

    def level(self, k: int) -> DataFrame:
        return self.spark.read.schema(_ARRAY).parquet(f"{self.path}/{self.levels[k]}")

    def _stored(self, array: DataFrame) -> tuple[str, DataFrame]:
        folder = new_path(self.spark, "array").rpartition("/")[2]
        return folder, store(array, folder, f"{self.path}/{folder}")

    def insert(self, rows: DataFrame) -> DataFrame:
        """The suffixes (head, name) that stand in rows twice, or in rows and the family."""
        folder, new = self._stored(sorted_array(rows))
        carried, levels, hits = new, dict(self.levels), [new.filter("n > 1").select(*SUFFIX)]
        gone: list[DataFrame] = []
        for k in sorted(self.levels):
            if k == len(gone) // 2:  # both have this size: they become one of the next
                gone += [carried, self.level(k)]
                del levels[k]
                folder, carried = self._stored(merge_scan(*gone[-2:]))
                hits.append(carried.filter("met").select(*SUFFIX))
            else:
                hits.append(merge_scan(new, self.level(k)).filter("met").select(*SUFFIX))
        found = hits[0]
        for more in hits[1:]:
            found = found.unionByName(more)
        found = store(found.distinct(), "suffix-hits")
        self.levels = levels | {len(gone) // 2: folder}
        self._saved()
        drop(*gone)
        return found

    def remove(self) -> None:
        """Empties the family's levels."""
        drop(*(self.level(k) for k in self.levels))
        self.levels = {}
        self._saved()


def new_matches(docs: DataFrame, family: IndexFamily, length: int = LENGTH) -> DataFrame:
    """Inserts the new batch docs(doc_id, text) into the family; doc_id, first, end of its long matches.

    A match is a string of ``length - BLOCK + 1`` bytes of a document's UTF-8 text that
    an earlier batch has, or this one has again.  Each string of ``length`` bytes with
    an equal one holds such a match.  Rows with equal or null doc_id are texts of their
    own; null text has none.
    """
    bound_batches(docs.sparkSession)
    own = keyed(docs.select("doc_id", "text")).withColumn("_text", utf8("text"))
    rows = store(suffix_rows(own, length).select("_key", "begin", *SUFFIX), "suffixes")
    hits = family.insert(rows)
    found = rows.join(hits, SUFFIX).select("_key", F.col("begin").alias("first"), (F.col("begin") + (length - BLOCK + 1)).alias("end"))
    return own.select("doc_id", "_key").join(found, "_key").drop("_key")


def repeated_runs(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    """Of docs(_key, _text): _key and runs, an array of [first, last] window starts that also start elsewhere."""
    window_rows = pa.schema([("_key", pa.int64()), ("at", pa.int32()), ("window_a", pa.int64()), ("window_b", pa.int64())])
    texts = docs.select("_key", "_text")
    every = store(suffix_rows(texts, length, batches).drop("begin"), "suffixes")
    family = IndexFamily.create(docs.sparkSession)
    hits = [family.insert(every.filter(F.col("batch") == k).select(*SUFFIX)) for k in range(batches)]
    family.remove()
    names = hits[0]
    for more in hits[1:]:
        names = names.unionByName(more)
    # what a join can split in pieces are tables read from storage: aggregates are stored first
    names = store(names.distinct(), "names")
    shared = store(every.join(names, SUFFIX).drop("batch", "head"), "shared")
    drop(*hits, names, every)
    # equal hulls: all their windows are repeats; else the windows of each kind of hull are compared
    hulls = shared.groupBy(*NAME, *HULL).agg(F.count("*").alias("copies"), F.min(F.struct("_key", "p0", "p1")).alias("one"))
    kinds = store(hulls.withColumn("known", F.col("copies") > 1), "hulls")
    open_ = kinds.groupBy(*NAME).agg(F.count("*").alias("kinds"), F.bool_or(~F.col("known")).alias("some")).filter("kinds > 1 and some").select(*NAME)
    open_ = store(open_, "open")
    asked = store(kinds.join(open_, NAME).select("one.*").groupBy("_key").agg(F.collect_list(F.struct("p0", "p1")).alias("blocks")), "asked")

    def windows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for rows in by_bytes(list(zip(*(c.to_pylist() for c in b.columns))), lambda r: len(r[1]), _STEP):
                for key, text, blocks in rows:
                    every_ = np.unique(np.concatenate([np.arange(x["p0"], x["p1"] + 1) for x in blocks]))
                    for at in np.split(every_, range(_LONG, len(every_), _LONG)):
                        yield batch(window_rows, np.full(len(at), key), at, *digests(text, at, at + length).T)

    each = store(texts.join(asked, "_key").mapInArrow(windows, "_key long, at int, window_a long, window_b long"), "windows")
    drop(open_, asked)
    twice = store(each.groupBy("window_a", "window_b").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "twice")
    single = each.join(twice, ["window_a", "window_b"]).select("_key", F.struct(F.col("at").alias("p0"), F.col("at").alias("p1")).alias("run"))
    known = shared.join(kinds.filter("known").select(*NAME, *HULL), [*NAME, *HULL]).select("_key", F.struct("p0", "p1").alias("run"))
    runs = store(known.unionByName(single).groupBy("_key").agg(F.sort_array(F.collect_list("run")).alias("runs")), "runs")
    drop(shared, kinds, each, twice)
    return runs


def shared_passages(docs: DataFrame, length: int = PASSAGE, gram: int = PASSAGE_GRAM) -> DataFrame:
    """_key of docs(_key, _text) that share a passage with another row.

    Of each window of ``length`` bytes the string of ``gram`` bytes with the least hash is
    chosen, so rows with an equal window choose an equal string: a row that has a passage
    of ``length`` bytes in common with another is always found, one without a common
    string of ``gram`` bytes never.
    """
    schema = pa.schema([("_key", pa.int64()), ("name_a", pa.int64()), ("name_b", pa.int64())])

    def choose(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            pieces = [(key, text[at : at + _LONG + length - 1]) for key, text in zip(*(c.to_pylist() for c in b.columns)) for at in range(0, max(0, len(text) - length + 1), _LONG)]
            for rows in by_bytes(pieces, lambda r: len(r[1]), _STEP):
                text = b"".join(r[1] for r in rows)
                lengths = np.array([len(r[1]) for r in rows])
                offsets = np.cumsum(lengths) - lengths
                own = SpanHash(np.frombuffer(text, "u1").astype("uint64") + np.uint64(1))
                i = np.arange(len(text) - gram + 1)
                hashes = (mix64((own.sums[gram:] - own.sums[:-gram]) * own._inverses[: len(i)]) & np.uint64(0xFFFFFFFFFF000000)) | i.astype("uint64")
                first = np.repeat(offsets, lengths)
                at = (sliding_least(hashes, length - gram + 1) & np.uint64(0xFFFFFF)).astype("int64")
                at = np.unique(at[first[: len(at)] == first[length - 1 :]])
                keys = np.array([r[0] for r in rows], "int64")[np.searchsorted(offsets, at, "right") - 1]
                yield batch(schema, keys, *digests(text, at, at + gram).T)

    chosen = store(docs.select("_key", "_text").mapInArrow(choose, "_key long, name_a long, name_b long"), "passages")
    several = store(chosen.groupBy(*NAME).agg(F.min("_key").alias("least"), F.max("_key").alias("most")).filter("least < most").select(*NAME), "shared-passages")
    found = store(chosen.join(several, NAME).select("_key").distinct(), "rows-with-passages")
    drop(chosen, several)
    return found


def remove_repeats(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES, as_text: bool = False, passages: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) with kept (bytes), n_bytes, n_removed, n_spans instead of text.

    A byte of the UTF-8 text goes if a string of ``length`` bytes that covers it also
    starts anywhere else, in another row or the same; strings are judged on the
    input and never cross rows.  So no copy of a repeat stays.  n_spans counts the
    maximal removed runs.  With as_text, kept is a string; characters of which a cut
    leaves a part go.  Null text counts as empty.  Rows with equal or null
    doc_id are rows of their own.  Other columns are carried along; those with the
    names of new ones are replaced.
    """
    bound_batches(docs.sparkSession)
    docs, named = shielded(docs, ("doc_id", "text"), ("kept", "n_bytes", "n_removed", "n_spans", *(("shares_passage",) if passages else ())))
    own = keyed(docs).withColumn("_text", utf8("text"))
    names = [c for c in docs.columns if c != "text"]
    kinds = dict(docs.dtypes)
    if passages:
        shared = shared_passages(own).withColumn("shares_passage", F.lit(True))
        own = own.join(shared, "_key", "left").na.fill(False, ["shares_passage"])
        names, kinds = [*names, "shares_passage"], kinds | {"shares_passage": "boolean"}

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for text, runs in zip(b.column("_text").to_pylist(), b.column("runs").to_pylist()):
                spans: list[list[int]] = []
                for run in runs or ():
                    start, end = run["p0"], run["p1"] + length
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(end, spans[-1][1])
                    else:
                        spans.append([start, end])
                edges = [0, *(x for s in spans for x in s), len(text)]
                kept = b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2])) if spans else text
                out.append((kept, len(text), len(text) - len(kept), len(spans)))
            kept_, *counts = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array([k.decode("utf-8", "ignore") for k in kept_], pa.string()) if as_text else pa.array(kept_, pa.binary()), *(pa.array(c, pa.int64()) for c in counts)], names=[*names, "kept", "n_bytes", "n_removed", "n_spans"])

    joined = own.join(repeated_runs(own, length, batches), "_key", "left").select(*names, "_text", "runs")
    return named(joined.mapInArrow(cut, ", ".join([*(f"{c} {kinds[c]}" for c in names), f"kept {'string' if as_text else 'binary'}, n_bytes long, n_removed long, n_spans long"])))
