"""Near-duplicate classes by MinHash with tensored banding (operator 3).

A document is the set of its distinct ``k``-word shingles (A-Z lower-cased;
fewer words: the whole sequence as one; none: empty, linked with nothing).
Each document gets ``COLLECTIONS`` small hash collections of ``ROWS`` minhashes
each.  Every pair of collections forms one table key, so 66 tables of four
minhashes cost 24 minhashes instead of 264.  Two sets of similarity 0.8 share a
collection with probability 0.64 and are missed only if fewer than two of the
twelve agree: 1.1e-4.  Candidates are confirmed on full sets.

Equal sets are one class from the start.  A table bucket first links each
member to one centre; only members whose components still differ afterwards
are compared with one another, first by a sketch inside the join and
then on full sets, so a large group of copies costs a star, not all pairs, and
no link that joins two components is left out.

Defined cases: null text and text without words: n_shingles 0, component_id =
doc_id, kept.  Null doc_id: its row is kept as a class of its own (component_id
null, kept).  Repeated doc_ids count as copies of one document.  An empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, arrow_map, byte_prefix, flat, forget, in_batches, mix, seeds, span_hash, table, text_bytes, windows, words

COLLECTIONS, ROWS = 12, 2
#: One-bit minhashes of candidates, and how many may differ: sets of similarity 0.8 differ in a tenth of
#: them (205, deviation 13.6), so the limit loses fewer than one such pair in ten million.
SKETCH_BITS, SKETCH_DIFFER = 2048, 280

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SKETCH_A, _SKETCH_B = seeds(SKETCH_BITS, 14), seeds(SKETCH_BITS, 15)
_A, _B = seeds(COLLECTIONS * ROWS, 11), seeds(COLLECTIONS * ROWS, 12)


def shingle_sets(column, k: int):
    """Yields each row's sorted distinct shingle hashes."""
    data, at = flat(column)
    data = _LOWER[data]
    start, stop, first = words(data, at)
    codes = span_hash(byte_prefix(data), start, stop)
    hashes, begin = windows(codes, first, k, 21)
    for row in range(len(at) - 1):
        if begin[row + 1] > begin[row]:
            h = np.sort(hashes[begin[row] : begin[row + 1]])
            yield h[np.concatenate(([True], h[1:] != h[:-1]))]
        else:
            few = codes[first[row] : first[row + 1]]
            yield mix(np.array([(few * seeds(k, 22)[: len(few)]).sum() + U64(len(few))], U64)) if len(few) else few


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (digest of the set) and c0.. (one 64-bit name per collection)."""
    names = [f"c{i}" for i in range(COLLECTIONS)]

    def sign(batch):
        n, digest, sig = [], [], []
        for s in shingle_sets(batch.column(1), k):
            n.append(len(s))
            digest.append(xxhash.xxh3_128_digest(s.tobytes()))
            if len(s):
                least = np.array(
                    [((s ^ b) * a).min() for a, b in zip(_A, _B, strict=True)]
                ) if len(s) > 4096 else ((s[:, None] ^ _B) * _A).min(axis=0)
            else:
                least = np.zeros(COLLECTIONS * ROWS, U64)
            sig.append(least)
        least = np.array(sig, U64).reshape(-1, COLLECTIONS, ROWS)
        names_of = np.zeros((len(least), COLLECTIONS), U64)
        for r in range(ROWS):
            names_of = mix(names_of + least[:, :, r] * seeds(ROWS, 13)[r])
        both = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
        out = {"doc_id": batch.column(0), "n_shingles": pa.array(n, pa.int64()), "d1": pa.array(both[:, 0]), "d2": pa.array(both[:, 1])}
        return out | {c: pa.array(names_of[:, i].view(np.int64)) for i, c in enumerate(names)}

    return arrow_map(text_bytes(docs), "doc_id long, n_shingles long, d1 long, d2 long, " + ", ".join(f"{c} long" for c in names), sign)


def _table_keys(reps: DataFrame) -> DataFrame:
    """rep, n_shingles and one row per table that may hold a second member: key names the table and its two collections, one and two say which these are.

    Two documents share a table only if they share both its collections, so collections (i, name) that
    one document has alone are left out before the tables are formed: 12 short rows a document instead of 66.
    """
    names = F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"c{i}").alias("name")) for i in range(COLLECTIONS)]))
    every = reps.select("rep", "n_shingles", names)
    often = table(
        every.groupBy("i", "name").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("i", "name"),
        "often"
    )
    held = every.join(often, ["i", "name"]).groupBy("rep").agg(
        F.first("n_shingles").alias("n_shingles"), F.array_sort(F.collect_list(F.struct("i", "name"))).alias("c")
    ).where(F.size("c") > 1)
    pairs = F.flatten(
        F.transform(
            "c",
            lambda x, k: F.transform(
                F.slice("c", k + 2, F.size("c")),
                lambda y: F.struct(F.xxhash64(x["i"], y["i"], x["name"], y["name"]).alias("key"), x["i"].alias("one"), y["i"].alias("two"))
            )
        )
    )
    out = table(held.select("rep", "n_shingles", F.inline(pairs)), "tables")
    forget(often)
    return out


def _confirm(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the edges (a, b) whose full sets are similar enough."""
    both = edges.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a")
    both = both.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b")

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return in_batches(both.select("a", "b", "sa", "sb"), "a long, b long", check)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and comp, the smallest node reachable: least-label rounds with pointer jumping, cut after each."""
    both = table(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    label = table(both.select(F.col("a").alias("node")).union(both.select("b")).groupBy("node").agg(F.min("node").alias("comp")), "label")
    held = label
    while True:
        seen = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("least"))
        lower = label.join(seen, "node").select("node", "comp", F.least("comp", "least").alias("next"))
        # Pointer jumping: a node whose least label is itself labelled lower takes that label.
        up = label.select(F.col("node").alias("next"), F.col("comp").alias("further"))
        lower = table(lower.join(up, "next").select("node", F.col("comp").alias("was"), F.least("next", "further").alias("comp")), "label")
        forget(held)
        held, label = lower, lower.select("node", "comp")
        if lower.where("was <> comp").isEmpty():
            return nodes.join(label, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    signed = table(signatures(docs, k), "signed")
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    names = [f"c{i}" for i in range(COLLECTIONS)]
    # Documents of one class have one set, so any copy's columns serve.
    reps = table(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), *[F.max(c).alias(c) for c in ["n_shingles", *names]]), "reps")

    keys = _table_keys(reps)
    shared = keys.groupBy("key").agg(F.min("rep").alias("centre"), F.max("rep").alias("last")).where("centre <> last").select("key", "centre")
    members = table(keys.join(table(shared, "shared"), "key"), "members")
    forget(keys)
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)

    candidates = members.select("rep").distinct()
    sets = table(_sets(docs, candidates, k), "sets")

    star = members.where("rep <> centre").groupBy(F.col("rep").alias("b")).agg(F.min("centre").alias("a")).select("a", "b")
    linked = table(_confirm(star, sets, percent), "star")
    label = table(components(candidates.select(F.col("rep").alias("node")), linked), "label")

    # What the star left apart: members of one bucket in different components, each pair once.
    placed = members.join(label.withColumnRenamed("node", "rep"), "rep").select("key", "one", "two", "rep", "n_shingles", "comp")
    sketch = [f"k{i}" for i in range(SKETCH_BITS // 64)]
    mixed = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    open_ = table(placed.join(mixed, "key").join(sets.select("rep", *sketch), "rep").join(reps.select("rep", *names), "rep"), "open")
    x, y = open_.alias("x"), open_.alias("y")
    differ = reduce(add, [F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in sketch])
    # Two documents meet in every table of collections they share; only the first of these tables compares them.
    is_first = reduce(and_, [(F.col("x.two") <= k) | (F.col("x.one") == k) | (F.col(f"x.c{k}") != F.col(f"y.c{k}")) for k in range(COLLECTIONS)])
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.comp") != F.col("y.comp"))
    apart = x.join(y, meet & fits(F.col("x.n_shingles"), F.col("y.n_shingles")) & is_first & (differ <= SKETCH_DIFFER))
    rest = apart.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).join(star, ["a", "b"], "left_anti")
    more = table(_confirm(rest, sets, percent), "rest")
    # Only the components that these links touch are joined; the others keep their label.
    to = lambda end: label.select(F.col("node").alias(end), F.col("comp").alias(f"{end}_comp"))
    merged = more.join(to("a"), "a").join(to("b"), "b").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")).distinct()
    joined = components(
        label.select(F.col("comp").alias("node")).distinct(), merged
    ).select(F.col("node").alias("comp"), F.col("comp").alias("whole"))
    label = label.join(joined, "comp").select("node", F.col("whole").alias("comp"))

    classes = reps.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", F.coalesce("comp", "rep").alias("comp"))
    out = signed.join(classes, ["d1", "d2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("comp", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def _sets(docs: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """rep, its sorted shingle hashes as bytes and its sketch, of the documents that have a candidate."""
    chosen = text_bytes(docs).join(reps.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")

    def build(batch):
        found = list(shingle_sets(batch.column(1), k))
        bits = np.zeros((len(found), SKETCH_BITS), np.uint8)
        for row, s in enumerate(found):
            least = [((s[i : i + 128, None] ^ _SKETCH_B) * _SKETCH_A).min(axis=0) for i in range(0, len(s), 128)]
            bits[row] = (np.min(least, axis=0) >> U64(17)) & U64(1)
        packed = np.packbits(bits, axis=1).view(np.int64)
        out = {"rep": batch.column(0), "shingles": pa.array([s.tobytes() for s in found], pa.binary())}
        return out | {c: pa.array(packed[:, i]) for i, c in enumerate(longs)}

    longs = [f"k{i}" for i in range(SKETCH_BITS // 64)]
    return arrow_map(chosen, "rep long, shingles binary, " + ", ".join(f"{c} long" for c in longs), build)
