"""Grouping of spelling variants: words one edit apart, found by automata of word halves."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foyer.llm.common import batch, bound_batches, drop, store, utf8

#: Words of a shard, and rows that carry them.
SHARD, PACKS = 1 << 17, 8
#: Distinct words that a counting task holds before it hands them on.
HELD = 200_000
#: Bytes of a word's row in the arrays; longer words are compared on their own.
WIDTH = 32
#: Pairs that are looked at in one step.
STEP = 1 << 20
#: Letters: runs of A-Z, a-z and U+00C0 to U+00FF.  All are single bytes in Latin-1, where A-Z become small and other bytes end a run.
_LETTERS = {*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)}
_RUNS = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _LETTERS else 32 for b in range(256))


def runs(text: str) -> list[bytes]:
    """Maximal runs of letters as Latin-1, with A-Z lower-cased."""
    return text.encode("latin-1", "replace").translate(_RUNS).split(b" ")


def misspelt(run: bytes, prefix: int, one_in: int) -> bytes:
    """The run without the character that the checksum of ``<doc_id>:<run>`` picks, if it is divisible by one_in; prefix: that of ``<doc_id>:``."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if h % one_in:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def count_words(docs: DataFrame, shortest: int = 7, one_in: int = 31) -> DataFrame:
    """docs(doc_id, text) as word, n: the runs of all texts after planted misspellings, of at least ``shortest`` characters.

    one_in 0 plants none.  A task counts what it meets and hands on its counts, so a
    frequent word comes to the sum as a row for each HELD distinct words of a task.
    """
    bound_batches(docs.sparkSession)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def flush(totals: Counter) -> pa.RecordBatch:
        words = [w.decode("latin-1") for w in totals]
        return batch(schema, words, list(totals.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter = Counter()
        for b in batches:
            for prefix, text in zip(b.column("prefix").to_pylist(), b.column("text").to_pylist()):
                own = Counter(w for w in runs(text) if len(w) >= shortest)
                start = zlib.crc32(prefix)
                for w, n in own.items():
                    if one_in:
                        w = misspelt(w, start, one_in)
                    totals[w] += n
                if len(totals) >= HELD:
                    yield flush(totals)
                    totals.clear()
        yield flush(totals)

    rows = docs.select(F.concat(utf8(F.col("doc_id").cast("string")), F.lit(b":")).alias("prefix"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "word string, n long").filter(F.length("word") >= shortest).groupBy("word").agg(F.sum("n").alias("n"))


class Shard:
    """An automaton of both halves of a shard's words, and what verifying needs.

    A word of m characters has a left half of m // 2 and a right half of the rest.  One
    edit leaves a half as it is: the left one at the start of the other word, or the
    right one at its end.
    """

    def __init__(self, words: list[str], n: np.ndarray):
        self.words, self.n = words, n
        self.size = np.fromiter(map(len, words), "int64", len(words))
        self.bytes = np.array([w[:WIDTH].encode("latin-1") for w in words], f"S{WIDTH}")
        self.rows = self.bytes.view("u1").reshape(len(words), WIDTH)
        # bit c % 64 is the parity of that letter's count: an insertion turns one, a replacement none or two
        parity = np.zeros(len(words), "uint64")
        for column in self.rows.T:
            parity ^= np.where(column > 0, np.uint64(1) << (column % 64).astype("uint64"), np.uint64(0))
        self.parity = parity

    def build(self) -> None:
        import ahocorasick

        halves: dict[str, int] = {}
        left = [halves.setdefault(w[: len(w) // 2], len(halves)) for w in self.words]
        right = [halves.setdefault(w[len(w) // 2 :], len(halves)) for w in self.words]
        self.automaton = ahocorasick.Automaton()
        for half, k in halves.items():
            self.automaton.add_word(half, k)
        self.automaton.make_automaton()
        self.half_size = np.fromiter(map(len, halves), "int64", len(halves))
        self.longest = int(self.size.max(initial=0))
        keys = np.concatenate([self.key(np.array(left), 0, self.size), self.key(np.array(right), 1, self.size)])
        order = np.argsort(keys, kind="stable")
        self.by_half = order % len(self.words)
        self.keys, self.first, self.count = np.unique(keys[order], return_index=True, return_counts=True)

    def key(self, half: np.ndarray, side: int, size: np.ndarray) -> np.ndarray:
        """Of the words of this size that have the half on this side (0: left, 1: right)."""
        return (half * 2 + side) * (self.longest + 2) + size

    def met(self, other: Shard) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(own words, other's words, side): other's are as long or longer by one, and have the half where it has to be."""
        text = "\n".join(other.words) + "\n"
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), "int64").reshape(-1, 2)
        ends, half = found[:, 0], found[:, 1]
        starts = np.cumsum(other.size + 1) - other.size - 1
        word = np.searchsorted(starts, ends, "right") - 1
        at_start, at_end = ends - self.half_size[half] + 1 == starts[word], ends + 1 == starts[word] + other.size[word]
        for side, there in ((0, at_start), (1, at_end)):
            for longer in (0, 1):
                size = other.size[word] - longer
                fits = there & (self.half_size[half] == (size // 2 if side == 0 else size - size // 2)) & (size <= self.longest)
                own_key, v = self.key(half[fits], side, size[fits]), word[fits]
                at = np.minimum(np.searchsorted(self.keys, own_key), max(len(self.keys) - 1, 0))
                known = self.keys[at] == own_key
                at, v = at[known], v[known]
                yield from self.spread(at, v, side)

    def spread(self, at: np.ndarray, v: np.ndarray, side: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """All words of the groups ``at``, each with its v, in steps of about STEP pairs; a group of any size is gone through in order."""
        ends = np.cumsum(self.count[at])
        total = int(ends[-1]) if len(ends) else 0
        for low in range(0, total, STEP):
            pair = np.arange(low, min(total, low + STEP))
            k = np.searchsorted(ends, pair, "right")
            yield self.by_half[self.first[at[k]] + pair - (ends[k] - self.count[at[k]])], v[k], side

    def near(self, other: Shard, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs one edit apart, each once: own words, and other's that are longer by one or else later.

        A pair of equal sizes is met from both shards, so it counts where own is the
        lesser word.  A pair that both halves meet counts at the left one.
        """
        for p, v, side in self.met(other):
            turned = np.bitwise_count(self.parity[p] ^ other.parity[v])
            shorter = self.size[p] < other.size[v]
            long_ = other.size[v] > WIDTH
            may = np.where(shorter, turned == 1, (turned == 0) | (turned == 2)) | long_
            if same:
                may &= p != v
            p, v, long_ = p[may], v[may], long_[may]
            a, b, m = self.rows[p], other.rows[v], self.size[p]
            differ = a != b
            first = np.where(differ.any(axis=1), differ.argmax(axis=1), WIDTH)
            equal = (self.size[p] == other.size[v]) & (differ.sum(axis=1) == 1) & (self.bytes[p] < other.bytes[v])
            shifted = a[:, : WIDTH - 1] != b[:, 1:]
            after = np.where(shifted.any(axis=1), WIDTH - 2 - shifted[:, ::-1].argmax(axis=1), -1)
            inserted = (self.size[p] + 1 == other.size[v]) & (after < first)
            ok = (equal | inserted) & ((first >= m // 2) if side == 0 else (first < m // 2))
            for k in np.flatnonzero(long_):
                ok[k] = self._long(self.words[p[k]], other.words[v[k]], side)
            yield p[ok], v[ok]

    @staticmethod
    def _long(w: str, v: str, side: int) -> bool:
        first = next((k for k, (x, y) in enumerate(zip(w, v)) if x != y), len(w))
        one = w[first:] == v[first + 1 :] if len(w) < len(v) else w < v and w[first + 1 :] == v[first + 1 :]
        return one and (first >= len(w) // 2) == (side == 0)


class Tally:
    """For each of a shard's words how many near words it has met, and the best of them: most frequent, then first in code-point order."""

    def __init__(self, shard: Shard):
        self.shard, self.count, self.best = shard, np.zeros(len(shard.words), "int64"), {}

    def add(self, own: np.ndarray, other: Shard, their: np.ndarray) -> None:
        self.count += np.bincount(own, minlength=len(self.count))
        order = np.lexsort((-other.n[their], own))
        own, their = own[order], their[order]
        top = other.n[their] == other.n[their][np.searchsorted(own, own)] if len(own) else np.zeros(0, "bool")
        for k, j in zip(own[top].tolist(), their[top].tolist()):  # the most frequent, more than one only if they tie
            new = (-int(other.n[j]), other.words[j])
            if k not in self.best or new < self.best[k]:
                self.best[k] = new

    def rows(self) -> list[tuple]:
        return [(self.shard.words[k], int(self.count[k]), -n, word) for k, (n, word) in self.best.items()]


def tally_tiles(words: DataFrame, shard_words: int = SHARD) -> DataFrame:
    """words(word, n), distinct, as word, n_near, best_n, best: of the words that have near ones, a row for each tile that has some.

    The words are cut by a hash into shards of about ``shard_words``.  Every pair of
    shards is a tile, in which the automaton of each scans the words of the other.  A
    tile holds two shards, so no task holds all words.
    """
    shards = max(1, -(-words.count() // shard_words))
    h = F.xxhash64("word", F.lit(11))
    packs = words.groupBy(F.pmod(h, F.lit(shards)).alias("shard"), F.pmod(F.shiftright(h, 32), F.lit(PACKS)).alias("pack")).agg(F.collect_list(F.struct("word", "n")).alias("own"))
    sides = packs.select(
        F.explode(
            F.concat(
                F.transform(F.sequence(F.col("shard"), F.lit(shards - 1)), lambda j: F.struct(F.col("shard").alias("i"), j.alias("j"), F.lit(0).alias("side"))),
                F.transform(F.sequence(F.lit(0).cast("long"), F.col("shard")), lambda i: F.struct(i.alias("i"), F.col("shard").alias("j"), F.lit(1).alias("side"))),
            )
        ).alias("tile"),
        F.col("own.word").alias("words"),
        F.col("own.n").alias("ns"),
    ).select("tile.*", "words", "ns")
    sides = sides.filter("i < j or side = 0")
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

    def run(key: tuple, t: pa.Table) -> pa.Table:
        found = {}
        for side, words_, ns in zip(t["side"].to_pylist(), t["words"].to_pylist(), t["ns"].to_pylist()):
            own = found.setdefault(side, ([], []))
            own[0].extend(words_)
            own[1].extend(ns)
        shards_ = [Shard(w, np.array(n, "int64")) for _, (w, n) in sorted(found.items())]
        same = key[0].as_py() == key[1].as_py()
        rows = []
        if same or len(shards_) == 2:
            tallies = [Tally(s) for s in shards_]
            for x in range(len(shards_)):
                y = x if same else 1 - x
                shards_[x].build()
                for p, v in shards_[x].near(shards_[y], same):
                    tallies[x].add(p, shards_[y], v)
                    tallies[y].add(v, shards_[x], p)
                del shards_[x].automaton
            rows = [r for tally in tallies for r in tally.rows()]
        return pa.Table.from_batches([batch(schema, *(zip(*rows) if rows else [[]] * 4))])

    return sides.groupBy("i", "j").applyInArrow(run, "word string, n_near long, best_n long, best string")


def roots(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """forms(word, form) without cycles as word, root: the end of the way over forms, by steps that double each round."""
    at = store(forms.select("word", F.col("form").alias("to")), "forms")
    for _ in range(rounds):
        ahead = at.select(F.col("word").alias("to"), F.col("to").alias("next"))
        new = store(at.join(ahead, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "forms")
        drop(at)
        at = new.drop("moved")
        if not new.filter("moved").limit(1).count():
            return at.withColumnRenamed("to", "root")
    raise RuntimeError("forms did not settle")


def group_variants(docs: DataFrame, shortest: int = 7, least: int = 2, one_in: int = 31, times: int = 10, shard_words: int = SHARD) -> DataFrame:
    """docs(doc_id, text) as word, form, root, n, n_near, form_n.

    Words are runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF; A-Z lower-cased) of at
    least ``shortest`` characters that occur ``least`` times or more; ``one_in`` plants
    misspellings first (see misspelt; 0: none).  Two words are near if one inserted,
    deleted or replaced character makes one the other.  A word's form is its near
    word of largest n (ties: smallest in code-point order) if that n is ``times`` times
    its own or more, else null; root is where following forms ends.  n grows from
    form to form, so that ends (``times`` above 1).

    Null and empty texts have no words, and a null doc_id counts as empty.  Repeated
    rows count each time.  An empty table gives an empty result.
    """
    words = store(count_words(docs, shortest, one_in).filter(F.col("n") >= least), "words")
    tiles = tally_tiles(words, shard_words).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best"))
    best_n = -F.col("best.n")
    formed = best_n >= F.lit(times) * F.col("n")
    near = words.join(tiles, "word", "left").select("word", F.when(formed, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, best_n).alias("form_n"))
    near = store(near, "near-words")
    ends = roots(near.filter("form is not null"))
    out = store(near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
    drop(words, near, ends)
    return out
