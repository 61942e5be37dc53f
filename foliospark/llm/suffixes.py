"""A sparse suffix array over a cluster: splitters, range partition, multikey quicksort, bounds.

Input are suffixes of texts, cut to the ``need`` bytes that matter: (id, start,
s).  Splitters sampled from all suffixes divide them by leading bytes (ties go
by id and start, so even a suffix that a third of all rows share is split over
buckets).  Each bucket sorts its own suffixes by multikey quicksort and takes
the common prefix of neighbours; the first and last suffix of each bucket are
compared with those of the next ones.  A suffix is repeated if a neighbour in
the array starts with all of it: those that do stand right behind it, or, if
they are equal, may stand right before it.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, flat, forget, in_batches, table

SUFFIX = "id long, start long, s binary"
#: About how many bytes a bucket holds, and how many suffixes are sampled for each.
BUCKET_BYTES, OVERSAMPLE = 16 << 20, 16


class Strings:
    """Byte strings side by side, read in pieces of eight bytes."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.at, self.size = at[:-1], np.diff(at)
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        self.padded = padded

    def piece(self, which: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes depth..depth+7 as one number, zeros past the end, and how many of them there are."""
        there = np.clip(self.size[which] - depth, 0, 8)
        begin = np.minimum(self.at[which] + depth, len(self.padded) - 8)
        word = np.zeros(len(which), U64)
        for j in range(8):
            word = (word << U64(8)) | np.where(there > j, self.padded[begin + j], 0).astype(U64)
        return word, there


def multikey_quicksort(strings: Strings) -> np.ndarray:
    """The order of the strings; equal ones stay as they were.

    All open segments are divided in step: by the eight bytes of their middle string into less, equal and
    greater; the equal part goes on eight bytes deeper, or is done where its strings end.
    """
    n = len(strings.size)
    order = np.arange(n)
    low, high, depth = (np.array([x], np.int64) for x in (0, n, 0))
    while True:
        open_ = high - low > 1
        low, high, depth = low[open_], high[open_], depth[open_]
        if not len(low):
            return order
        size = high - low
        begin = np.cumsum(size) - size
        segment = np.repeat(np.arange(len(low)), size)
        place = np.arange(size.sum()) - np.repeat(begin - low, size)
        word, there = strings.piece(order[place], depth[segment])
        middle = begin + size // 2
        pivot, ends = word[middle], there[middle]
        side = np.where(word == pivot[segment], np.sign(there - ends[segment]), np.where(word < pivot[segment], -1, 1)) + 1
        counts = np.bincount(3 * segment + side, minlength=3 * len(low)).reshape(-1, 3)
        first = np.concatenate((np.zeros((len(low), 1), np.int64), np.cumsum(counts, axis=1)[:, :2]), axis=1) + low[:, None]
        to = np.empty(len(place), np.int64)
        for k in range(3):
            of = side == k
            rank = np.cumsum(of) - of
            to[of] = first[segment[of], k] + rank[of] - rank[begin][segment[of]]
        order[to] = order[place]
        stop = first + counts
        equal = ends == 8
        low = np.concatenate((first[:, 0], first[equal, 1], first[:, 2]))
        high = np.concatenate((stop[:, 0], stop[equal, 1], stop[:, 2]))
        depth = np.concatenate((depth, depth[equal] + 8, depth))


def common_prefix(strings: Strings, order: np.ndarray) -> np.ndarray:
    """Bytes that each string has in common with the next in order (one less than strings)."""
    one, two = order[:-1], order[1:]
    out = np.zeros(len(one), np.int64)
    open_ = np.arange(len(one))
    while len(open_):
        depth = out[open_]
        (x, nx), (y, ny) = strings.piece(one[open_], depth), strings.piece(two[open_], depth)
        differ = x ^ y
        # The highest bit that differs tells the byte; a float's exponent finds it once the low half is masked away.
        high = differ >> U64(32)
        byte = np.where(
            high > 0, 3 - (np.log2(np.maximum(high, 1).astype(np.float64)).astype(np.int64) >> 3),
            7 - (np.log2(np.maximum(differ & U64(0xFFFFFFFF), 1).astype(np.float64)).astype(np.int64) >> 3)
        )
        same = np.minimum(np.where(differ == 0, 8, byte), np.minimum(nx, ny))
        out[open_] += same
        open_ = open_[same == 8]
    return out


def splitters(suffixes: DataFrame) -> list[tuple[bytes, int, int]]:
    """Bounds between buckets: OVERSAMPLE suffixes for each bucket, picked by a hash of their place, come to the driver."""
    n, size = suffixes.agg(F.count("*"), F.sum(F.length("s"))).first()
    buckets = max(1, -(-(size or 0) // BUCKET_BYTES))
    if buckets == 1:
        return []
    every = max(1, n // (buckets * OVERSAMPLE))
    sample = suffixes.where(F.pmod(F.xxhash64("start", "id"), F.lit(every)) == 0).toArrow()
    keys = sorted(zip(sample["s"].to_pylist(), sample["id"].to_pylist(), sample["start"].to_pylist(), strict=True))
    return [keys[len(keys) * k // buckets] for k in range(1, buckets)] if len(keys) >= buckets else keys


def repeated_suffixes(suffixes: DataFrame) -> DataFrame:
    """id, start, need of the suffixes (a table with SUFFIX's columns, deleted then) that stand somewhere else too."""
    bounds = splitters(suffixes)

    def deal(batches):
        for batch in batches:
            s, ids, start = (batch.column(k).to_pylist() for k in (2, 0, 1))
            bucket = [bisect_right(bounds, key) for key in zip(s, ids, start, strict=True)] if bounds else [0] * len(s)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket, pa.int32())], names=["id", "start", "s", "bucket"])

    def sort(key, rows):
        rows = rows.combine_chunks().sort_by([("id", "ascending"), ("start", "ascending")])
        column = rows["s"].combine_chunks()
        data, at = flat(column)
        strings = Strings(data, at)
        order = multikey_quicksort(strings)
        shared = common_prefix(strings, order)
        need = strings.size[order]
        seen = np.zeros(len(order), bool)
        seen[:-1] |= shared >= need[:-1]
        seen[1:] |= shared >= need[1:]
        edge = [None] * len(order)
        for k in (0, len(order) - 1):
            edge[k] = column[int(order[k])].as_py()
        rank = np.zeros(len(order), np.int64)
        rank[-1] = 1
        if len(order) == 1:
            rank[0] = 2
        take = np.zeros(len(order), bool)
        take[[0, -1]] = True
        take |= seen
        kept = np.flatnonzero(take)
        out = {
            "id": rows["id"].to_numpy()[order][kept], "start": rows["start"].to_numpy()[order][kept],
            "need": need[kept], "seen": seen[kept], "bucket": np.full(len(kept), key[0].as_py(), np.int32),
            "side": rank[kept]
        }
        return pa.Table.from_pydict(out | {"edge": pa.array([edge[k] for k in kept], pa.binary())})

    dealt = in_batches(suffixes.select("id", "start", "s"), SUFFIX + ", bucket int", deal)
    done = table(
        dealt.repartition(len(bounds) + 1, "bucket").groupBy("bucket").applyInArrow(
            sort, "id long, start long, need long, seen boolean, bucket int, side long, edge binary"
        ),
        "suffixes"
    )
    forget(suffixes)
    # Two rows for each bucket, as many as there are splitters.
    ends = done.where("edge IS NOT NULL").orderBy("bucket", "side").toArrow().to_pylist()
    more = []
    for a, b in zip(ends, ends[1:]):
        if a["bucket"] != b["bucket"]:
            more += [x for x, y in ((a, b), (b, a)) if not x["seen"] and y["edge"].startswith(x["edge"])]
    found = done.where("seen").select("id", "start", "need")
    if more:
        found = found.union(
            found.sparkSession.createDataFrame([(x["id"], x["start"], x["need"]) for x in more], "id long, start long, need long").distinct()
        )
    return found
