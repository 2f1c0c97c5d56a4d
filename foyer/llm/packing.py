"""Best-fit packing of documents into sequences, improved by swap-based local search.

Every document becomes token ids and an end id; only documents longer than a
sequence are cut.  Pieces are dealt to groups of bounded size by a hash; one task
packs one group: best fit by decreasing length, then a local search among the
underfull bins that exchanges one piece for one, two for one, or moves a piece,
whenever that raises the sum of squared fills, until bins empty.  Bins that stay
underfull are dissolved and packed again with those of other groups, in rounds of
fewer pieces, until one group is left or a round hardly leaves fewer; the bins of
the last round stay, whatever they hold.
"""

from __future__ import annotations

import itertools
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foyer.llm.common import batch, bound_batches, by_bytes, fresh, store, utf8
from foyer.llm.tokens import encoder

CAPACITY = 2048
#: Pieces that one task packs at a time.
GROUP_PIECES = 40_000
#: Bins filled below this share are dissolved and packed again with other groups' bins.
FULL = 0.995
#: A round that leaves more than this share of its pieces in underfull bins is the last.
SHRUNK = 0.9
#: Underfull bins that are searched together; all are, in blocks ordered by room.
SEARCHED = 400

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece of a document of docs(doc_id, text): doc_id, piece, start, length, ids_crc32.

    Null text counts as empty, so each document has at least its end id.  Repeated
    rows give repeated pieces.  A document longer than capacity is cut from its
    end, so only its first piece can be shorter.
    """
    bound_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer)
        for b in batches:
            for rows in by_bytes(list(zip(*(c.to_pylist() for c in b.columns))), lambda r: len(r[1]), 2 << 20):
                out: list[tuple] = []
                for (doc_id, _), ids in zip(rows, tokens.encode([r[1] for r in rows])):
                    ids += end
                    n = len(ids) // 4
                    first = n % capacity or capacity
                    for k, start in enumerate([0, *range(first, n, capacity)]):
                        own = ids[4 * start : 4 * (start + capacity if k else first)]
                        out.append((doc_id, k, start, len(own) // 4, zlib.crc32(own)))
                yield batch(schema, *zip(*out))

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, PIECES)


def best_fit(sizes: list[int], capacity: int) -> tuple[list[list[int]], list[int]]:
    """Bins as lists of indices, and their free room; by decreasing size into the fullest bin that has room."""
    bins: list[list[int]] = []
    room: list[int] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room
    some = 0  # bit r is set if free[r] has bins
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n = sizes[i]
        if fit := some >> n:
            r = n + (fit & -fit).bit_length() - 1
            k = free[r].pop()
            if not free[r]:
                some ^= 1 << r
            bins[k].append(i)
        else:
            k, r = len(bins), capacity
            bins.append([i])
            room.append(0)
        room[k] = left = r - n
        if left:
            if not free[left]:
                some |= 1 << left
            free[left].append(k)
    return bins, room


def blocks(bins: list[list[int]], room: list[int], searched: int) -> list[list[int]]:
    """All underfull bins in blocks, the emptiest first."""
    under = sorted((k for k in range(len(bins)) if bins[k] and room[k]), key=lambda k: -room[k])
    return [under[at : at + searched] for at in range(0, len(under), searched)]


def local_search(bins: list[list[int]], room: list[int], sizes: list[int], searched: int = SEARCHED) -> None:
    """Searches all underfull bins block by block, until that raises the sum of squared fills no more."""
    settled: set[tuple] = set()
    state = lambda own: tuple(tuple(bins[k]) for k in own)
    squares = lambda own: sum(sum(sizes[i] for i in bins[k]) ** 2 for k in own)
    gain = 1
    while gain > 0:
        gain = 0
        for own in blocks(bins, room, searched):
            if (was := state(own)) in settled:
                continue
            before = squares(own)
            search_block(bins, room, sizes, own)
            gain += squares(own) - before
            if state(own) == was:
                settled.add(was)


def search_block(bins: list[list[int]], room: list[int], sizes: list[int], under: list[int]) -> None:
    """Raises the fills of these underfull bins until no exchange among them does; bins may become empty.

    A step takes an underfull bin A and a bin B that is no fuller, and puts a piece of B
    into A (move), or exchanges a piece of A for a larger one of B (one for one), or
    one of A for two of B that are longer together (two for one), if A has room.
    """
    by_size: list[tuple[int, int, int]] = sorted((sizes[i], k, i) for k in under for i in bins[k])

    def put(i: int, a: int, b: int) -> None:
        """Piece i goes from bin a to bin b."""
        bins[a].remove(i)
        bins[b].append(i)
        room[a] += sizes[i]
        room[b] -= sizes[i]
        del by_size[bisect_left(by_size, (sizes[i], a, i))]
        insort(by_size, (sizes[i], b, i))

    def largest(least: int, most: int, a: int, other: int = -1) -> tuple[int, int, int] | None:
        """The largest piece of size least..most in a bin no fuller than a."""
        at = bisect_right(by_size, (most, 1 << 60, 0)) - 1
        while at >= 0 and by_size[at][0] >= least:
            n, k, i = by_size[at]
            if k != a and i != other and room[k] >= room[a]:
                return by_size[at]
            at -= 1
        return None

    for a in sorted(under, key=lambda k: room[k]):
        better = True
        while better and room[a] and bins[a]:
            better = False
            if found := largest(1, room[a], a):
                put(found[2], found[1], a)
                better = True
                continue
            for i in sorted(bins[a], key=lambda i: sizes[i]):
                n, gap = sizes[i], room[a]
                if found := largest(n + 1, n + gap, a):
                    put(i, a, found[1])
                    put(found[2], found[1], a)
                    better = True
                    break
                if (one := largest((n + gap) // 2, n + gap - 1, a)) and (two := largest(max(1, n + 1 - one[0]), n + gap - one[0], a, one[2])):
                    if two[1] == one[1] or room[one[1]] + one[0] >= n:
                        put(i, a, one[1])
                        put(one[2], one[1], a)
                        put(two[2], two[1], a)
                        better = True
                        break


def pack_group(sizes: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each piece: its bin, its offset there, and the room that the bin keeps."""
    bins, room = best_fit(sizes, capacity)
    local_search(bins, room, sizes)
    kept: set[int] = set(range(len(bins)))
    for worst in blocks(bins, room, SEARCHED):
        left = [i for k in worst for i in bins[k]]
        again, more = best_fit([sizes[i] for i in left], capacity)
        if len(again) < len(worst):
            kept.difference_update(worst)
            kept.update(range(len(bins), len(bins) + len(again)))
            bins += [[left[j] for j in b] for b in again]
            room += more
    found = np.zeros((3, len(sizes)), "int64")
    for k in sorted(kept):
        own, at = bins[k], 0
        for i in own:
            found[:, i] = k, at, room[k]
            at += sizes[i]
    return found[0], found[1], found[2]


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """pieces(length, ...) with sequence_id and offset: few sequences, no piece over another.

    Lengths are 1 to capacity.  The other columns are carried along, whatever their
    names; an empty table gives an empty result.
    """
    n_, bin_, at_, left_, group_ = fresh(pieces, "piece_no", "bin_no", "place", "room", "pack_group")
    todo = store(pieces.withColumn(n_, F.monotonically_increasing_id()), "pieces")
    columns = [c for c in todo.columns if c != n_]
    slim = todo.select(n_, "length")
    done: list[DataFrame] = []
    count = slim.count()
    for level in itertools.count():
        groups = max(1, round(count / group_pieces))

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values([n_], kind="stable")
            bins, at, left = pack_group(pdf["length"].tolist(), capacity)
            return pd.DataFrame({n_: pdf[n_], "length": pdf["length"], bin_: bins + (int(pdf[group_].iloc[0]) << 28) + (level << 56), at_: at, left_: left})

        packed = store(
            slim.withColumn(group_, F.pmod(F.xxhash64(n_, F.lit(level)), F.lit(groups)).cast("int")).groupBy(group_).applyInPandas(fit, f"{n_} long, length long, {bin_} long, {at_} long, {left_} long"),
            "packed",
        )
        full = F.col(left_) <= int(capacity * (1 - FULL))
        before, count = count, packed.filter(~full).count()
        if groups == 1 or count > SHRUNK * before:
            done.append(packed)
            break
        done.append(packed.filter(full))
        slim = packed.filter(~full).select(n_, "length")
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    return todo.join(placed.select(n_, F.col(bin_).alias("sequence_id"), F.col(at_).alias("offset")), n_).select(*columns, "sequence_id", "offset")
