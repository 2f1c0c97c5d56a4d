"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foyer.llm.common import batch, bound_batches, by_bytes, drop, mix64, store, utf8
from foyer.llm.components import components
from foyer.llm.recompress import word_names

#: Bits of the fingerprint and words of a shingle.
BITS, SHINGLE = 64, 3
#: Fingerprints of one cell that are compared in one step.
CELL = 256
_LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


def simhash(text: bytes, shingle: int = SHINGLE, seed: int = 42) -> int:
    """A bit is 1 if over half of the shingles' XXH64 values have it; no words give 0."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a : b - 1], seed) for a, b in zip(starts[:n], starts[min(shingle, len(words)) :])), "<u8", n)
    ones = np.zeros(BITS, "int64")
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="int64")
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs(doc_id, text) as doc_id, fp (the 64 bits as a signed long)."""
    bound_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([simhash(t, shingle) for t in b.column("text").to_pylist()], "uint64")
            yield batch(schema, b.column("doc_id"), found.view("int64"))

    return docs.select("doc_id", utf8("text").alias("text")).mapInArrow(run, "doc_id long, fp long")


def forest(a: np.ndarray, b: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that connect what pairs of a x b within the distance connect: one less than nodes at most."""
    near = np.bitwise_count(a[:, None] ^ b[None, :]) <= most
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    links = []
    for i, j in zip(*np.nonzero(near)):
        x, y = root(int(a[i])), root(int(b[j]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            links.append((int(a[i]), int(b[j])))
    return links


def near_links(fps: DataFrame, most: int = 3) -> DataFrame:
    """fps(fp, distinct) as links (a, b): a table whose components are those of all pairs within ``most`` bits.

    Multi-index hashing: of two fingerprints within 3 bits, one half differs by at
    most one bit.  The table holds each half's values as cells; a cell is looked up by
    the values of its Hamming ball of radius 1 (each pair of cells from the side that
    lacks the bit).  Cells that meet are compared in full distance.  A cell of more
    than CELL fingerprints is split by a hash, and its parts are compared part by
    part, so no task holds a cell; of the near pairs of two parts a spanning forest
    comes out, which keeps every component.
    """
    assert most <= 3
    half = lambda k: F.col("fp").bitwiseAND(0xFFFFFFFF) if k == 0 else F.shiftrightunsigned("fp", 32)
    cells = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), half(k).alias("v")) for k in (0, 1)))).alias("x")).select("fp", F.col("x.k").alias("k"), F.col("x.v").alias("v"))
    sizes = cells.groupBy("k", "v").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts"))
    parts = store(cells.join(sizes, ["k", "v"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).groupBy("k", "v", "parts", "part").agg(F.sort_array(F.collect_list("fp")).alias("fps")), "cells")
    keys = parts.select("k", "v").distinct()
    flips = F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(i.alias("bit"), F.expr("v").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)).alias("v"))), lambda x: x["v"] != F.col("v"))
    probes = keys.select("k", F.col("v").alias("own"), F.explode(F.transform(flips, lambda x: x["v"])).alias("v"))
    met = probes.join(keys, ["k", "v"]).select("k", F.col("own").alias("v"), F.col("v").alias("w"))
    one = met.join(parts.select("k", "v", F.col("fps").alias("a")), ["k", "v"])
    two = parts.select("k", F.col("v").alias("w"), F.col("fps").alias("b"))
    crossed = one.join(two, ["k", "w"]).select("a", "b")
    # inside a cell: each part with itself and with the parts after it
    several = parts.filter((F.col("parts") > 1) | (F.size("fps") > 1))
    inside = several.select("k", "v", F.col("fps").alias("a"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("part")).join(several.select("k", "v", "part", F.col("fps").alias("b")), ["k", "v", "part"]).select("a", "b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            found = []
            for a, b in zip(r.column("a"), r.column("b")):
                found += forest(a.values.to_numpy(), b.values.to_numpy(), most)
            yield batch(schema, *(zip(*found) if found else ([], [])))

    return crossed.unionByName(inside).mapInArrow(compare, "a long, b long").filter("a <> b").distinct()


def near_duplicates(docs: DataFrame, most: int = 3, shingle: int = SHINGLE) -> DataFrame:
    """docs(doc_id, text) as doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over fingerprints that differ in at
    most ``most`` bits.  Null and empty texts have fingerprint zero.  Repeated rows stay
    repeated; a null doc_id gets the component of its fingerprint.  An empty table
    gives an empty result.
    """
    own = store(fingerprints(docs, shingle), "fingerprints")
    fps = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = fps.join(components(near_links(fps.select("fp"), most)), fps["fp"] == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    joined = store(joined, "classes")
    first = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = joined.join(first, "component").select(F.col("fp").alias("_fp"), "component_id")
    return own.join(by_fp, own["fp"] == F.col("_fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- similarity of shingles

#: Words of a shingle and similarity from which documents are near, tables that one job looks up, and the least words of 64 bits of a wide fingerprint.
NEAR_SHINGLE, NEAR, TABLES, LEAST_WORDS = 5, 0.8, 4, 16
#: Share of pairs of exactly that similarity which some table has to lead to, and how far below it the estimate of a link may lie.
FOUND, SLACK = 0.95, 0.03


def differing(similarity: float) -> float:
    """Share of SimHash bits in which texts of this Jaccard similarity differ on average: their angle, as a part of a half turn."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def tables_for(n: int, similarity: float = NEAR, found: float = FOUND) -> tuple[int, int]:
    """(bits, tables): segments for n fingerprints.

    The values of a segment outnumber the fingerprints 16 times, so unlike ones seldom
    meet; there are so many segments that a pair of this similarity differs by one bit at
    most in some, with probability found.
    """
    bits = max(16, min(62, math.ceil(math.log2(max(n, 2))) + 4))
    d = differing(similarity)
    one = (1 - d) ** bits + bits * d * (1 - d) ** (bits - 1)
    return bits, math.ceil(math.log(1 - found) / math.log(1 - one))


_ODD = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], "uint64")
#: Shingles that one step of a text counts the bits of, in runs that a byte can count.
_RUN, _STEP = 255, 255 * 32


def shingle_hashes(names: np.ndarray, shingle: int) -> np.ndarray:
    """Hashes of a text's shingles from the hashes of its words; fewer words are one shingle."""
    n = len(names)
    size = min(shingle, n)
    total = np.full(max(n - size + 1, 0) if n else 0, size, "uint64")
    for k in range(size):
        total = mix64(total + names[k : n - size + 1 + k] * _ODD[k % len(_ODD)] + np.uint64(k))
    return total


def wide_simhash(hashes: np.ndarray, words: int) -> bytes:
    """SimHash of words * 64 bits: each word from the hashes mixed with a seed of its own; none give zeros.

    Bits are counted eight at a time: bit j of each byte of a hash goes to a byte of
    its own, and a run of 255 of these adds up without a carry.
    """
    ones, lanes = np.zeros((words, 8, 8), "int64"), np.uint64(0x0101010101010101)
    seeds = (np.arange(1, words + 1, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15))[:, None]
    for at in range(0, len(hashes), _STEP):
        part = hashes[at : at + _STEP]
        mixed = np.zeros((words, -(-len(part) // _RUN) * _RUN), "uint64")
        mixed[:, : len(part)] = mix64(part[None, :] + seeds)
        for j in range(8):
            sums = ((mixed >> np.uint64(j)) & lanes).reshape(words, -1, _RUN).sum(axis=2, dtype="uint64")
            ones[:, :, j] += sums.view("u1").reshape(words, -1, 8).sum(axis=1, dtype="int64")
    return np.packbits(2 * ones.reshape(words, BITS) > len(hashes), axis=1, bitorder="little").tobytes()


def wide_simhashes(texts: list[bytes], words: int, shingle: int = NEAR_SHINGLE) -> list[bytes]:
    """Of each text, with A-Z lower-cased; a text without words has zeros."""
    counts, names = word_names([t.translate(_LOWER) for t in texts])
    ends = np.cumsum(counts)
    return [wide_simhash(shingle_hashes(names[e - n : e], shingle), words) for e, n in zip(ends, counts)]


def wide_fingerprints(docs: DataFrame, words: int, shingle: int = NEAR_SHINGLE) -> DataFrame:
    """docs(doc_id, text) as doc_id, wide."""
    bound_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("wide", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in by_bytes(list(zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())), lambda r: len(r[1])):
                yield batch(schema, [r[0] for r in rows], wide_simhashes([r[1] for r in rows], words, shingle))

    return docs.select("doc_id", utf8("text").alias("text")).mapInArrow(run, "doc_id long, wide binary")


def _segments(nodes: DataFrame, tables: range, bits: int) -> DataFrame:
    """nodes(node, wide) as node, wide, k, v: the value of each of these segments."""
    schema = pa.schema([("node", pa.int64()), ("wide", pa.binary()), ("k", pa.int32()), ("v", pa.int64())])
    weights = np.uint64(1) << np.arange(bits, dtype="uint64")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            wide = b.column("wide")
            all_bits = np.unpackbits(np.frombuffer(b"".join(wide.to_pylist()), "u1").reshape(b.num_rows, -1), axis=1, bitorder="little")
            for k in tables:
                yield batch(schema, b.column("node"), wide, np.full(b.num_rows, k, "i4"), (all_bits[:, k * bits : (k + 1) * bits] * weights).sum(axis=1, dtype="uint64").view("int64"))

    return nodes.mapInArrow(run, "node long, wide binary, k int, v long")


def wide_forest(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], most: int) -> list[tuple[int, int]]:
    """Links that connect what pairs of a x b (nodes, wide words) within the distance connect."""
    far = np.zeros((len(a[0]), len(b[0])), "int32")
    for x, y in zip(a[1].T, b[1].T):
        far += np.bitwise_count(x[:, None] ^ y[None, :])
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    links = []
    for i, j in zip(*np.nonzero(far <= most)):
        x, y = root(int(a[0][i])), root(int(b[0][j]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            links.append((int(a[0][i]), int(b[0][j])))
    return links


def _met_links(nodes: DataFrame, tables: range, bits: int, most: int) -> DataFrame:
    """Links (a, b) between nodes(node, wide, all distinct) within ``most`` bits that meet in one of these tables.

    As near_links(): a cell is looked up by its Hamming ball of radius 1, each pair of
    cells from the side that lacks the bit; cells of more than CELL are compared part by
    part, and of what is near in two parts a spanning forest comes out.
    """
    cells = _segments(nodes, tables, bits)
    sizes = store(cells.groupBy("k", "v").agg(F.count("*").alias("n")), "sizes")
    large = sizes.filter(F.col("n") > CELL).select("k", "v", F.ceil(F.col("n") / CELL).cast("int").alias("parts"))
    split = cells.join(large, ["k", "v"], "left").na.fill(1, ["parts"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    parts = store(split.groupBy("k", "v", "parts", "part").agg(F.collect_list(F.struct("node", "wide")).alias("own")), "parts")
    ball = F.filter(F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.expr("v").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))), lambda x: x != F.col("v"))
    met = sizes.select("k", F.col("v").alias("own_v"), F.explode(ball).alias("v")).join(sizes.select("k", "v"), ["k", "v"]).select("k", F.col("own_v").alias("v"), F.col("v").alias("w"))
    crossed = met.join(parts.select("k", "v", F.col("own").alias("a")), ["k", "v"]).join(parts.select("k", F.col("v").alias("w"), F.col("own").alias("b")), ["k", "w"]).select("a", "b")
    several = parts.filter((F.col("parts") > 1) | (F.size("own") > 1))
    inside = several.select("k", "v", F.col("own").alias("a"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("part")).join(several.select("k", "v", "part", F.col("own").alias("b")), ["k", "v", "part"]).select("a", "b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def side(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each row's nodes start, the nodes, and their words."""
        flat, ends = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        ids = flat.field("node").to_numpy()
        return ends, ids, np.frombuffer(b"".join(flat.field("wide").to_pylist()), "<u8").reshape(len(ids), -1)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            if not r.num_rows:
                continue
            (i, a, x), (j, b, y) = side(r.column("a")), side(r.column("b"))
            single = (np.diff(i) == 1) & (np.diff(j) == 1)  # most cells: all such pairs at once
            p, q = i[:-1][single], j[:-1][single]
            near = np.bitwise_count(x[p] ^ y[q]).sum(axis=1, dtype="int32") <= most
            found = list(zip(a[p[near]].tolist(), b[q[near]].tolist()))
            for k in np.flatnonzero(~single):
                s, t = slice(i[k], i[k + 1]), slice(j[k], j[k + 1])
                found += wide_forest((a[s], x[s]), (b[t], y[t]), most)
            yield batch(schema, *(zip(*found) if found else ([], [])))

    links = store(crossed.unionByName(inside).mapInArrow(compare, "a long, b long").filter("a <> b").distinct(), "links")
    drop(sizes, parts)
    return links


def similar_groups(docs: DataFrame, similarity: float = NEAR, shingle: int = NEAR_SHINGLE) -> DataFrame:
    """docs(doc_id, text), doc_ids distinct, as doc_id, component_id: the smallest doc_id reachable over near texts.

    Texts are near if their sets of shingles have about this Jaccard similarity or more.
    Multi-index hashing over a wide SimHash: tables_for() says how many segments it has,
    which grows with the documents so that the share of pairs that some segment leads to
    stays; pairs that meet are compared in complete distance.  The distance estimates the
    similarity with a standard error of about 0.02 at 1024 bits and 0.8; SLACK leans to
    linking.  Texts without words are one group.  An empty table gives an empty result.
    """
    bits, tables = tables_for(docs.count(), similarity)
    words = max(LEAST_WORDS, -(-bits * tables // BITS))
    own = store(wide_fingerprints(docs, words, shingle), "wide")
    nodes = store(own.groupBy("wide").agg(F.min("doc_id").alias("node")), "nodes")
    most = int(differing(similarity - SLACK) * BITS * words)
    # what the first tables join is one node for the others, whose links would tell the same again
    grouped = store(components(_met_links(nodes, range(min(TABLES, tables)), bits, most)).select(F.col("node").alias("_node"), F.col("component").alias("_group")), "groups")
    links = None
    for k in range(TABLES, tables, TABLES):
        new = _met_links(nodes, range(k, min(tables, k + TABLES)), bits, most)
        for end in ("a", "b"):
            new = new.join(grouped, F.col(end) == F.col("_node"), "left").withColumn(end, F.coalesce("_group", end)).drop("_node", "_group")
        new = new.filter("a <> b").distinct()
        links = new if links is None else links.unionByName(new)
    joined = nodes.join(grouped, F.col("node") == F.col("_node"), "left").withColumn("component", F.coalesce("_group", "node")).select("wide", "component")
    if links is not None:
        joined = joined.join(components(links).select(F.col("node").alias("_node"), F.col("component").alias("_group")), F.col("component") == F.col("_node"), "left").select("wide", F.coalesce("_group", "component").alias("component"))
    classes = joined.select(F.col("wide").alias("_wide"), F.col("component").alias("component_id"))
    return own.join(classes, own["wide"] == F.col("_wide")).select("doc_id", "component_id")
