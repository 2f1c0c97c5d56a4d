"""Hard negatives by a vector-approximation file."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foyer.llm.common import batch, drop, store

#: Cells of a dimension, and rows and anchors that one task compares at a time.
CELLS, ROWS, ANCHORS = 256, 8192, 512
#: A score is a sum of products that has to fit a long, so components are held within the root of LARGEST / dimensions.
LARGEST = 1 << 62
_NO_ID = np.iinfo("int64").max
_FILE = "block long, keys binary, ids binary, nameless binary, labels binary, cells binary, vectors binary"


def usable(label: Column | str, vector: Column | str) -> Column:
    """A row takes part if it has a label and all its components are finite numbers."""
    return F.col(label).isNotNull() & F.coalesce(F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integers(vector: Column | str, scale: float, most: int) -> Column:
    """floor(scale * x) of each component; beyond ``most`` it is held there."""
    return F.transform(F.col(vector), lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(most))), F.lit(float(-most)))).cast("long"))


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Lists as rows; shorter ones end in zeros."""
    out = np.zeros((len(vectors), dim), "int64")
    offsets = vectors.offsets.to_numpy()
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(vectors)), sizes)
    out[row, np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], sizes)] = vectors.values.to_numpy()[offsets[0] : offsets[-1]]
    return out


class Grid:
    """Cells of equal width in each dimension, between its least and its largest component."""

    def __init__(self, least: np.ndarray, most: np.ndarray):
        self.least, self.most = least, most
        self.step = (most - least) // CELLS + 1

    def cells(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.least) // self.step).astype("u1")

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(dimension, cell, 2): least and largest product of q's component with a component in the cell."""
        low = self.least[:, None] + np.arange(CELLS) * self.step[:, None]
        ends = np.stack([np.minimum(low, self.most[:, None]), np.minimum(low + self.step[:, None] - 1, self.most[:, None])]) * q[:, None]
        sums = np.abs(ends).max(axis=(0, 2)).sum()
        return np.ascontiguousarray(np.stack([ends.min(axis=0), ends.max(axis=0)], axis=-1).astype("int32" if sums < 2**31 else "int64"))


def bounds(tables: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest possible score of each row; cells: (dimension, row)."""
    total = np.zeros((cells.shape[1], 2), tables.dtype)
    if tables.dtype == np.int32:  # both bounds by one look-up
        for t, c in zip(tables.view("int64")[:, :, 0], cells):
            total += t.take(c).view("int32").reshape(-1, 2)
    else:
        for t, c in zip(tables, cells):
            total += t.take(c, axis=0)
    return total[:, 0], total[:, 1]


def largest(values: np.ndarray, k: int) -> int:
    """The k-th largest; fewer values exclude nothing."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else np.iinfo("int64").min


class Block:
    """A row of the approximation file as arrays."""

    def __init__(self, row: dict, dim: int):
        self.keys, self.ids, self.labels = (np.frombuffer(row[c], "int64") for c in ("keys", "ids", "labels"))
        self.nameless = np.frombuffer(row["nameless"], "u1")
        self.cells = np.frombuffer(row["cells"], "u1").reshape(dim, -1)
        self.vectors = np.frombuffer(row["vectors"], "int64").reshape(-1, dim)

    def best(self, at: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Positions in ``at`` of the k first: by score, then by id."""
        return np.lexsort((self.keys[at], self.ids[at], self.nameless[at], -scores))[:k]


def approximation_file(rows: DataFrame, dim: int, name: str = "approximations") -> tuple[DataFrame, Grid, int]:
    """rows(key, vec_id, label, vector of longs) as a table of blocks of about ROWS rows, its grid and the number of blocks.

    The grid has two numbers for each dimension, from all rows.
    """
    ends = rows.select(F.posexplode("vector").alias("d", "x")).groupBy("d").agg(F.min("x").alias("least"), F.max("x").alias("most"))
    least, most = np.zeros(dim, "int64"), np.zeros(dim, "int64")
    n, shortest = rows.agg(F.count("*"), F.min(F.size("vector"))).first()
    short = n and shortest < dim
    for r in ends.collect():  # a row for each dimension
        least[r.d], most[r.d] = (min(r.least, 0), max(r.most, 0)) if short else (r.least, r.most)
    grid = Grid(least, most)
    schema = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("keys", "ids", "nameless", "labels", "cells", "vectors"))])

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        x = _matrix(t["vector"].chunk(0), dim)
        ids = t["vec_id"].fill_null(int(_NO_ID)).to_numpy()
        parts = t["key"].to_numpy(), ids, t["vec_id"].is_null().to_numpy(zero_copy_only=False).astype("u1"), t["label"].to_numpy(), np.ascontiguousarray(grid.cells(x).T), x
        return pa.Table.from_batches([batch(schema, [key[0].as_py()], *([p.tobytes()] for p in parts))])

    blocks = max(1, -(-n // ROWS))
    packed = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).groupBy("block").applyInArrow(pack, _FILE)
    return store(packed, name), grid, blocks


def scan(anchors: DataFrame, n_anchors: int, file: DataFrame, blocks: int, compare, out: pa.Schema, ddl: str) -> DataFrame:
    """compare(anchor, block) over every anchor and block, in tiles of about ANCHORS anchors and one block.

    Each tile is a group, so neither side is held whole anywhere; compare returns a
    list of rows.
    """
    parts = max(1, -(-n_anchors // ANCHORS))
    one = anchors.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    two = file.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        for b in right.to_pylist():
            for a in left.to_pylist():
                found += compare(a, b)
        return pa.Table.from_batches([batch(out, *(zip(*found) if found else [[]] * len(out)))])

    return one.groupBy("part", "block").cogroup(two.groupBy("part", "block")).applyInArrow(run, ddl)


def _query(a: dict, dim: int) -> np.ndarray:
    q = np.zeros(dim, "int64")
    q[: len(a["vector"])] = a["vector"]
    return q


def _positives(a: dict, b: dict, grid: Grid, dim: int, k: int, cache: dict) -> list[tuple]:
    """The anchor's k first rows of its label in the block."""
    block, own = _opened(b, dim, cache), cache
    if a["label"] not in own["by_label"]:
        own["by_label"][a["label"]] = np.flatnonzero(block.labels == a["label"])
    at, q = own["by_label"][a["label"]], _query(a, dim)
    at = at[block.keys[at] != a["key"]]
    low, high = bounds(grid.tables(q), block.cells[:, at])
    at = at[high >= largest(low, k)]
    scores = block.vectors[at] @ q
    best = block.best(at, scores, k)
    return [(a["key"], block.keys[i], block.ids[i], bool(block.nameless[i]), s) for i, s in zip(at[best].tolist(), scores[best].tolist())]


def _negatives(a: dict, b: dict, grid: Grid, dim: int, k: int, least: int, most: int, cache: dict) -> list[tuple]:
    """For each positive of the anchor the k first rows of other labels in the block whose score is in its window."""
    block, q = _opened(b, dim, cache), _query(a, dim)
    low, high = bounds(grid.tables(q), block.cells)
    other, found = block.labels != a["label"], []
    for p in a["positives"]:
        first, last = -(-least * p["score"] // 100), most * p["score"] // 100
        may = other & (high >= first) & (low <= last)
        sure = low[may & (low >= first) & (high <= last)]
        at = np.flatnonzero(may & (high >= largest(sure, k)))
        scores = block.vectors[at] @ q
        inside = (scores >= first) & (scores <= last)
        at, scores = at[inside], scores[inside]
        best = block.best(at, scores, k)
        found += [(a["key"], p["rank"], block.keys[i], block.ids[i], bool(block.nameless[i]), s) for i, s in zip(at[best].tolist(), scores[best].tolist())]
    return found


def _opened(b: dict, dim: int, cache: dict) -> Block:
    """The block as arrays, kept while the same one is scanned."""
    if cache.get("of") is not b:
        cache.update(of=b, block=Block(b, dim), by_label={})
    return cache["block"]


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: float = 256.0) -> DataFrame:
    """vectors(vec_id, label, embedding) as anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the inner product of floor(scale * x).  An anchor's positives are its
    first ``positives`` other rows of its label: by score, then by vec_id.  For each
    positive come the first ``negatives`` rows of other labels whose score is between
    ``least`` and ``most`` percent of the positive's.

    The vector-approximation file holds each component's cell, of CELLS in its
    dimension.  For an anchor, tables give each cell's least and largest product; their
    sums bound a row's score.  Only rows that these bounds leave in question are scored
    exactly, and each tile returns its own first rows, so the final ranks see
    ``negatives`` rows of each tile at most.

    Rows with a null label, a null vector or a component that is null or not finite take
    no part.  Shorter vectors count as if they ended in zeros; an empty one scores 0.
    Components beyond the root of LARGEST / dimensions after scaling are held there.
    Rows that share a vec_id are rows of their own; a null vec_id comes after all
    others.  A negative score of a positive has no window.  No rows or no anchors give
    an empty result.
    """
    known = vectors.select("vec_id", "label", "embedding").withColumn("anchor", F.coalesce(anchor, F.lit(False))).filter(usable("label", "embedding"))
    dim = max(1, known.agg(F.max(F.size("embedding"))).first()[0] or 0)
    held = int((LARGEST / dim) ** 0.5)
    rows = store(known.select(F.monotonically_increasing_id().alias("key"), F.col("vec_id").cast("long"), F.col("label").cast("long"), integers("embedding", scale, held).alias("vector"), "anchor"), "vectors")
    file, grid, blocks = approximation_file(rows.drop("anchor"), dim)
    anchors = rows.filter("anchor").drop("anchor")
    n = anchors.count()
    pair = pa.schema([("key", pa.int64()), ("other", pa.int64()), ("id", pa.int64()), ("nameless", pa.bool_()), ("score", pa.int64())])
    near = scan(anchors, n, file, blocks, partial(_positives, grid=grid, dim=dim, k=positives, cache={}), pair, "key long, other long, id long, nameless boolean, score long")
    order = (F.col("score").desc(), "nameless", "id", "other")
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(*order))).filter(F.col("rank") <= positives)
    own_id = F.when(~F.col("nameless"), F.col("id"))
    chosen = store(ranked.select("key", "rank", "score", own_id.alias("positive_id")), "positives")
    windows = chosen.groupBy("key").agg(F.collect_list(F.struct("rank", "score")).alias("positives"))
    triple = pa.schema([("key", pa.int64()), ("positive", pa.int32()), *list(pair)[1:]])
    hard = scan(anchors.join(windows, "key"), n, file, blocks, partial(_negatives, grid=grid, dim=dim, k=negatives, least=least, most=most, cache={}), triple, "key long, positive int, other long, id long, nameless boolean, score long")
    first = hard.withColumn("rank", F.row_number().over(W.partitionBy("key", "positive").orderBy(*order))).filter(F.col("rank") <= negatives)
    first = first.select("key", "positive", "rank", own_id.alias("negative_id"), F.col("score").alias("negative_score"))
    scored = chosen.select("key", F.col("rank").alias("positive"), "positive_id", F.col("score").alias("positive_score"))
    out = first.join(scored, ["key", "positive"]).join(anchors.select("key", F.col("vec_id").alias("anchor_id")), "key")
    out = store(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives")
    drop(rows, file, chosen)
    return out
