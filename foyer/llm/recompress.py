"""Substring deduplication by recompression.

Every document is a sequence of symbols, at first its words.  A round of Spark names
runs and pairs of neighboring symbols; a name depends on what it stands for alone, so
equal word sequences get equal names in whichever document they stand.  Each symbol
keeps the span of words that decided it.  The names that a round made are grouped over
the whole corpus: one that a single document has can't lie inside a repeat, so all
windows around it are closed, and what no open window covers leaves the sequences.
The next round pairs the symbols that remain.  After the last round the runs of windows
that are still open, all of whose symbols are shared, are verified: runs that are equal
from end to end as wholes, the first of each window by window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foyer.llm.common import batch, bound_batches, by_bytes, drop, keyed, mix64, shielded, store, utf8

#: Words of the repeats that are removed, and rounds of naming.
WINDOW, ROUNDS = 13, 4
#: Words of a part of a document that is named at a time; parts overlap by a window.
PART = 100_000
#: Symbols that one step of a task holds.
STEP = 400_000
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def split_words(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of texts laid end to end: how many each text has, the distinct ones, and of each word its place among these."""
    lists = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
    words, ends = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    filled = pc.binary_length(words).to_numpy() > 0  # white space at a text's ends leaves empty words
    if not filled.all():
        ends = np.concatenate([[0], np.cumsum(filled)])[ends]
        words = words.filter(pa.array(filled))
    coded = words.dictionary_encode()
    return np.diff(ends), coded.dictionary.cast(pa.binary()), coded.indices.to_numpy()


def word_names(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """How many words each text has, and the 64-bit names of all."""
    counts, words, codes = split_words(texts)
    return counts, np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), "u8", len(words))[codes]


def word_digests(texts: list[bytes]) -> tuple[np.ndarray, bytes]:
    """How many words each text has, and the 128-bit hashes of all, 16 bytes each."""
    counts, words, codes = split_words(texts)
    return counts, np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words.to_pylist())), "S16")[codes].tobytes()


@dataclass
class Symbols:
    """Symbols of texts laid end to end: name, words start..stop, and the words left..right that decided it."""

    name: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def take(self, which: np.ndarray) -> Symbols:
        return Symbols(*(x[which] for x in (self.name, self.start, self.stop, self.left, self.right)))


def name_runs(words: np.ndarray, first: np.ndarray) -> tuple[Symbols, np.ndarray]:
    """Words as symbols, runs of equal ones as one; and which are runs.

    first: for each word the place where its text starts.  Where a run ends is decided
    by the words beside it, so they belong to what decides a symbol.
    """
    same = (words[1:] == words[:-1]) & (first[1:] == first[:-1])
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(words)), bool), ~same]))
    stop = np.append(start[1:], len(words))[: len(start)]
    long_ = stop - start > 1
    name = np.where(long_, mix64(words[start] * _A + (stop - start).astype("uint64")), words[start])
    return Symbols(name, start, stop, start - 1, stop + 1), np.flatnonzero(long_)


def name_pairs(s: Symbols, edge: np.ndarray, level: int) -> tuple[Symbols, np.ndarray]:
    """s with its pairs named, and where these are.

    edge: true for a symbol that no other stands directly before.  A bit of its name
    gives every symbol a side; neighbors of which the left one has side 1 and the right
    one side 0 become a pair.  Such pairs can't overlap, and whether two neighbors merge
    depends on them alone; a symbol that stays is also decided by the one that it might
    have merged with.
    """
    if len(s.name) < 2:
        return s, np.empty(0, "int64")
    side = (mix64(s.name + np.uint64(level)) >> np.uint64(17)) & np.uint64(1) == 1
    near = ~edge[1:]
    at = np.flatnonzero(side[:-1] & ~side[1:] & near)
    left, right = s.left.copy(), s.right.copy()
    right[:-1] = np.where(side[:-1] & near, np.maximum(s.right[:-1], s.right[1:]), s.right[:-1])
    left[1:] = np.where(~side[1:] & near, np.minimum(s.left[1:], s.left[:-1]), s.left[1:])
    name, stop = s.name.copy(), s.stop.copy()
    name[at] = mix64(s.name[at] * _A + mix64(s.name[at + 1] + _B))
    stop[at] = s.stop[at + 1]
    left[at], right[at] = np.minimum(s.left[at], s.left[at + 1]), np.maximum(s.right[at], s.right[at + 1])
    keep = np.ones(len(name), bool)
    keep[at + 1] = False
    return Symbols(name, s.start, stop, left, right).take(keep), at - np.arange(len(at))


def inside(s: Symbols, open_: np.ndarray, window: int) -> np.ndarray:
    """Which symbols some open window holds with all that decided them; open_: true where such a window starts."""
    count = np.concatenate([[0], np.cumsum(open_)])
    lo, hi = np.maximum(s.right - window, 0), np.minimum(s.left + 1, len(open_))
    return (hi > lo) & (count[np.maximum(hi, 0)] > count[np.minimum(lo, len(open_))])


def close(s: Symbols, open_: np.ndarray, window: int) -> np.ndarray:
    """open_ without the windows that hold one of s with all that decided it."""
    lo, hi = np.maximum(s.right - window, 0), np.minimum(s.left + 1, len(open_))
    change = np.zeros(len(open_) + 1, "int64")
    some = hi > lo
    np.add.at(change, lo[some], 1)
    np.add.at(change, hi[some], -1)
    return open_ & (np.cumsum(change[:-1]) == 0)


def covered(s: Symbols, open_: np.ndarray, window: int) -> np.ndarray:
    """Which symbols have a word in an open window."""
    change = np.zeros(len(open_) + window + 1, "int64")
    at = np.flatnonzero(open_)
    change[at] += 1
    change[at + window] -= 1
    count = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1])[: len(open_)] > 0)])
    return count[s.stop] > count[s.start]


_ROW = "_key long, _order long, base int, n int, name binary, skip binary, width binary, left binary, right binary, open binary, new_at binary, new array<long>"
_FAR = 255  # what decided a symbol is so far away that no window holds it


def packed(keys: np.ndarray, n: np.ndarray, s: Symbols, open_: np.ndarray, new: np.ndarray) -> pa.RecordBatch:
    """Rows of the parts (keys: _key, _order, base; n: words) that open windows are left of."""
    off = np.concatenate([[0], np.cumsum(n)])
    part = np.searchsorted(off, s.start, "right") - 1
    skip = s.start - np.where(np.concatenate([np.ones(min(1, len(part)), bool), part[1:] != part[:-1]]), off[part], np.concatenate([np.zeros(min(1, len(part)), "int64"), s.stop[:-1]]))
    edges = np.searchsorted(s.start, off)
    near = lambda d: np.minimum(d, _FAR).astype("u1")
    columns = [s.name, skip.astype("<i4"), (s.stop - s.start).astype("<i4"), near(s.start - s.left), near(s.right - s.start)]
    starts = np.flatnonzero(np.diff(np.concatenate([[0], open_.astype("i1")])) == 1)
    ends = np.flatnonzero(np.diff(np.concatenate([open_.astype("i1"), [0]])) == -1)
    runs, run_edges = np.stack([starts, ends], axis=1), np.searchsorted(starts, off)
    new_edges = np.searchsorted(new, edges)
    kept = np.flatnonzero(np.diff(run_edges))
    blobs = [[c[edges[k] : edges[k + 1]].tobytes() for k in kept] for c in columns]
    windows = [(runs[run_edges[k] : run_edges[k + 1]] - off[k]).astype("<i4").tobytes() for k in kept]
    made = [new[new_edges[k] : new_edges[k + 1]] for k in kept]
    at = [(m - edges[k]).astype("<i4").tobytes() for m, k in zip(made, kept)]
    values = np.concatenate(made) if made else np.empty(0, "int64")
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(m) for m in made], dtype="int64")]), pa.int32()), pa.array(s.name[values].view("int64")))
    own = keys[kept]
    whole = [pa.array(own[:, 0], pa.int64()), pa.array(own[:, 1], pa.int64()), pa.array(own[:, 2], pa.int32()), pa.array(n[kept], pa.int32()), *(pa.array(x, pa.binary()) for x in (*blobs, windows, at)), lists]
    return pa.RecordBatch.from_arrays(whole, names=[x.split()[0] for x in _ROW.split(", ")])


def unpacked(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, Symbols, np.ndarray, np.ndarray, np.ndarray]:
    """keys, n, symbols, edges, open windows, and where the new names are, as packed() got them."""
    keys = np.stack([b.column(c).to_numpy() for c in ("_key", "_order", "base")], axis=1)
    n = b.column("n").to_numpy().astype("int64")
    off = np.concatenate([[0], np.cumsum(n)])
    blob = lambda c, kind: [np.frombuffer(x.as_buffer(), kind) for x in b.column(c)]
    join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    names = blob("name", "<u8")
    count = np.array([len(x) for x in names], "int64")
    first = np.cumsum(count) - count
    skip, width = (join(blob(c, "<i4"), "<i4").astype("int64") for c in ("skip", "width"))
    # a symbol starts after all that was skipped and all that came before it in its part
    ahead = np.cumsum(skip) + np.cumsum(width) - width
    before = np.concatenate([[0], ahead + width])[first]  # at the end of the part before
    start = ahead - np.repeat(before - off[:-1], count)
    s = Symbols(join(names, "<u8"), start, start + width, start - join(blob("left", "u1"), "u1"), start + join(blob("right", "u1"), "u1"))
    edge = skip != 0
    edge[first[count > 0]] = True
    change = np.zeros(int(off[-1]) + 1, "int64")
    for runs, o in zip(blob("open", "<i4"), off):
        change[runs[::2] + o] += 1
        change[runs[1::2] + o + 1] -= 1
    new = join([x + f for x, f in zip(blob("new_at", "<i4"), first)], "int64")
    return keys, n, s, edge, np.cumsum(change[:-1]) > 0, new


def first_pairs(texts: list[bytes], window: int) -> tuple | None:
    """Of texts in parts of PART words: text, base and n of each part, and of these laid end to end the symbols after words, runs and the first pairs were named, edges, windows, and where the new names are."""
    counts, names = word_names(texts)
    before = np.cumsum(counts) - counts
    split = [(k, at, min(c - at, PART + window - 1)) for k, c in enumerate(counts.tolist()) for at in range(0, max(0, c - window + 1), PART)]
    if not split:
        return None
    parts = np.array([x[:2] for x in split], "int64")
    n = np.array([x[2] for x in split])
    named = np.concatenate([names[before[k] + at : before[k] + at + m] for k, at, m in split])
    off = np.cumsum(n) - n
    s, runs = name_runs(named, np.repeat(off, n))
    starts = s.start[runs]
    edge = np.zeros(len(s.start), bool)
    edge[np.searchsorted(s.start, off)] = True
    open_ = np.arange(len(named)) <= np.repeat(off + n - window, n)
    after, pairs = name_pairs(s, edge, 1)
    new = np.zeros(len(after.start), bool)
    new[pairs] = True
    new[np.flatnonzero(np.isin(after.start, starts))] = True  # a run, or a pair that begins with one
    edge = np.zeros(len(after.start), bool)
    edge[np.searchsorted(after.start, off)] = True
    return parts, n, after, edge, open_, np.flatnonzero(new & inside(after, open_, window))


def first_round(texts: DataFrame, window: int) -> DataFrame:
    """Of texts(_key, _order, _text): _key, _order, base, and new, the names of the first round in each part of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in by_bytes(list(zip(*(c.to_pylist() for c in b.columns))), lambda r: len(r[2])):
                if (found := first_pairs([r[2] for r in rows], window)) is None:
                    continue
                parts, n, s, _, _, new = found
                ends = np.searchsorted(new, np.searchsorted(s.start, np.cumsum(n)))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(s.name[new].view("int64")))
                keys = np.array([r[:2] for r in rows], "int64")[parts[:, 0]]
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(parts[:, 1], pa.int32()), lists], names=["_key", "_order", "base", "new"])

    return texts.mapInArrow(run, "_key long, _order long, base int, new array<long>")


def second_round(texts: DataFrame, window: int) -> DataFrame:
    """The sequences that open windows are left of after the first round, with their second pairs named.

    texts: rows with parts, the places of shared names in new of first_round() by base.
    The first names are made again, which is less than to keep and move all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in by_bytes(list(zip(*(b.column(c).to_pylist() for c in ("_key", "_order", "_text", "parts")))), lambda r: len(r[2])):
                if (found := first_pairs([r[2] for r in rows], window)) is None:
                    continue
                parts, n, s, edge, open_, new = found
                ends = np.searchsorted(new, np.searchsorted(s.start, np.cumsum(n)))
                first = np.concatenate([[0], ends[:-1]])
                alive = [{p["base"]: p["alive"] for p in r[3] or ()} for r in rows]
                dead = np.ones(len(new), bool)
                for (k, base), o in zip(parts.tolist(), first):
                    if at := alive[k].get(base):
                        dead[np.asarray(at) + o] = False
                keys = np.column_stack([np.array([r[:2] for r in rows], "int64")[parts[:, 0]], parts[:, 1]])
                yield advanced(keys, n, s, edge, close(s.take(new[dead]), open_, window), 2, window)

    return texts.mapInArrow(run, _ROW)


def advanced(keys: np.ndarray, n: np.ndarray, s: Symbols, edge: np.ndarray, open_: np.ndarray, level: int, window: int) -> pa.RecordBatch:
    """Rows of what open windows cover, with the pairs of this level named."""
    keep = covered(s, open_, window)
    # a symbol whose neighbor goes was decided by that, too, so no open window holds it with what decided it
    edge = (edge | np.concatenate([np.zeros(min(1, len(keep)), bool), ~keep[:-1]]))[keep]
    s, pairs = name_pairs(s.take(keep), edge, level)
    found = np.zeros(len(s.start), bool)
    found[pairs] = True
    return packed(keys, n, s, open_, np.flatnonzero(found & inside(s, open_, window)))


def closed(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple]:
    """Of rows with alive (the places in new of names that several documents have): keys, n, symbols, edges and the windows that are still open."""
    for whole in batches:
        sizes = [len(x.as_buffer()) // 8 for x in whole.column("name")]
        for rows in by_bytes(list(range(len(sizes))), sizes.__getitem__, STEP):
            b = whole.slice(rows[0], len(rows))
            keys, n, s, edge, open_, new = unpacked(b)
            count = np.array([len(x.as_buffer()) // 4 for x in b.column("new_at")], "int64")
            dead = np.ones(len(new), bool)
            for at, o in zip(b.column("alive").to_pylist(), np.cumsum(count) - count):
                if at:
                    dead[np.asarray(at) + o] = False
            yield keys, n, s, edge, close(s.take(new[dead]), open_, window)


def next_round(sequences: DataFrame, level: int, window: int) -> DataFrame:
    """The sequences after unshared names have closed their windows, and new pairs were named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in closed(batches, window):
            yield advanced(*part, level, window)

    return sequences.mapInArrow(run, _ROW)


def open_windows(sequences: DataFrame, window: int) -> DataFrame:
    """_key, p0, p1: the windows [p0, p1] that are still open when unshared names have closed theirs."""
    rows_of = pa.schema([("_key", pa.int64()), ("p0", pa.int32()), ("p1", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n, _, _, open_ in closed(batches, window):
            off = np.cumsum(n) - n
            change = np.diff(np.concatenate([[0], open_.astype("i1"), [0]]))
            p0, p1 = np.flatnonzero(change == 1), np.flatnonzero(change == -1) - 1
            part = np.searchsorted(off, p0, "right") - 1
            shift = keys[part, 2] - off[part]
            yield batch(rows_of, keys[part, 0], p0 + shift, p1 + shift)

    return sequences.mapInArrow(run, "_key long, p0 int, p1 int")


def shared(named: DataFrame) -> DataFrame:
    """_key, base and alive, the places in new of names that documents of several ranks have; named: _key, _order, base, new."""
    each = named.select("_key", "base", "_order", F.posexplode("new").alias("at", "name"))
    # stored, so that the join reads two shuffles and Spark can split a name that very many documents have
    several = store(each.groupBy("name").agg(F.min("_order").alias("least"), F.max("_order").alias("most")).filter("least < most").select(F.col("name").alias("_name")), "shared")
    alive = store(each.join(several, F.col("name") == F.col("_name")).groupBy("_key", "base").agg(F.collect_list("at").alias("alive")), "alive")
    drop(several)
    return alive


def span_digests(texts: DataFrame, window: int, each: bool) -> DataFrame:
    """_key, _order, p0, p1, a, b: 128-bit hashes of the words of runs of windows, or of each of their windows.

    texts: _key, _order, _text and p0, p1, the first and last windows of its runs.
    """
    rows_of = pa.schema([("_key", pa.int64()), ("_order", pa.int64()), ("p0", pa.int32()), ("p1", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
    digest = xxhash.xxh3_128_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in by_bytes(list(zip(*(b.column(c).to_pylist() for c in ("_key", "_order", "_text", "p0", "p1")))), lambda r: len(r[2])):
                counts, words = word_digests([r[2] for r in rows])
                runs = np.array([len(r[3]) for r in rows])
                row = np.repeat(np.arange(len(rows)), runs)
                first, last = (np.concatenate([np.asarray(r[c], "int64") for r in rows]) for c in (3, 4))
                if each:
                    n = last - first + 1
                    first = last = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                    row = np.repeat(row, n)
                shift = (np.cumsum(counts) - counts)[row]
                keys = np.array([r[:2] for r in rows], "int64")
                for at in range(0, len(row), STEP):
                    k, i, j, o = (x[at : at + STEP] for x in (row, first, last, shift))
                    found = np.frombuffer(b"".join([digest(words[x:y]) for x, y in zip((16 * (i + o)).tolist(), (16 * (j + o + window)).tolist())]), "<i8").reshape(-1, 2)
                    yield batch(rows_of, keys[k, 0], keys[k, 1], i, j, *found.T)

    return texts.mapInArrow(run, "_key long, _order long, p0 int, p1 int, a long, b long")


def repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """Of docs(_key, _order, _text): _key and runs, an array of [p0, p1], windows that a lower rank has too."""
    texts = docs.select("_key", "_order", "_text")
    first = store(first_round(texts, window), "first-names")
    alive = shared(first)
    drop(first)
    parts = alive.groupBy("_key").agg(F.collect_list(F.struct("base", "alive")).alias("parts"))
    sequences = store(second_round(texts.join(parts, "_key", "left"), window), "round")
    drop(alive)
    for level in range(3, rounds + 2):
        alive = shared(sequences.select("_key", "_order", "base", "new"))
        known = sequences.drop("new").join(alive, ["_key", "base"], "left")
        if level <= rounds:
            after = store(next_round(known, level, window), "round")
        else:
            after = store(open_windows(known, window), "open")
        drop(alive, sequences)
        sequences = after

    def digested(runs: DataFrame, each: bool, name: str) -> tuple[DataFrame, DataFrame]:
        """Spans of runs(_key, p0, p1), and the least rank of each."""
        listed = runs.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("p0", "p1"))).alias("r")).select("_key", "r.p0", "r.p1")
        spans = store(span_digests(texts.join(listed, "_key"), window, each), name)
        # stored, so that the join reads two shuffles and Spark can split what very many documents have
        return spans, store(spans.groupBy("a", "b").agg(F.min("_order").alias("least")), f"least-{name}")

    # of runs that are equal from end to end only the first's windows are looked at one by one
    whole, least = digested(sequences, False, "runs")
    judged = store(whole.join(least, ["a", "b"]).select("_key", "p0", "p1", (F.col("_order") > F.col("least")).alias("later")), "judged")
    drop(sequences, whole, least)
    each, least = digested(judged.filter("not later"), True, "windows")
    single = each.join(least, ["a", "b"]).filter("_order > least").select("_key", "p0", "p1")
    both = judged.filter("later").select("_key", "p0", "p1").unionByName(single)
    found = store(both.groupBy("_key").agg(F.collect_list(F.struct("p0", "p1")).alias("runs")), "repeats")
    drop(judged, each, least)
    return found


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text, ...) with text, n_words and n_removed.

    A word goes if a window of ``window`` words that covers it also starts in a
    document with a smaller doc_id (null is smallest); windows are judged on the
    input.  The words left are joined by single spaces.  Words are runs of bytes other
    than white space of ASCII; null text has none.  Rows that share a doc_id don't
    remove each other's words.  Other columns are carried along; those with the names
    of new ones are replaced.
    """
    bound_batches(docs.sparkSession)
    docs, named = shielded(docs, ("doc_id", "text"), ("n_words", "n_removed"))
    own = keyed(docs).withColumn("_text", utf8("text"))
    kept = [c for c in docs.columns if c != "text"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, runs in zip(b.column("_text").to_pylist(), b.column("runs").to_pylist()):
                words = text.split()
                n = len(words)
                if runs:
                    change = np.zeros(n + 1, "int64")
                    np.add.at(change, [r["p0"] for r in runs], 1)
                    np.add.at(change, [r["p1"] + window for r in runs], -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(change[:n]) == 0)]
                out.append((b" ".join(words).decode(), n, n - len(words)))
            text, n_words, n_removed = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(text, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=[*kept, "text", "n_words", "n_removed"])

    joined = own.join(repeats(own, window), "_key", "left").select(*kept, "_text", "runs")
    return named(joined.mapInArrow(cut, ", ".join([*(f"{c} {t}" for c, t in docs.dtypes if c in kept), "text string, n_words long, n_removed long"])))
