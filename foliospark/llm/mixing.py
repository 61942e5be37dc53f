"""Mixing sources to target weights by entropy balancing (operator 6, DataFrame functions only).

Document rates r minimise the relative entropy to one copy of each document
subject to each source's tokens meeting its target and r <= ``most``.  The dual
is convex with one multiplier per source; its solution tilts exponentially,
r = min(most, exp(lambda * size / mean size)).  Newton rounds, guarded by a
bracket, evaluate the constraints over the corpus's (source, size) counts until
all are met.  Rates become whole copies in blocks of about ``block_rows``
documents of a source, from the longest to the shortest, each document taking
over the tokens by which those before it missed their rate.

Sums over documents are decimal, so they don't depend on the order of rows and
reruns agree.

Defined cases: null text has size 0; documents of size 0 take 0 words and one
copy; the null source is a source of its own, last in order; a source without
words has target 0; repeated rows are documents of their own; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, table

WEIGHTS = (5, 2, 1)
_SPACE = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, _SPACE))).cast("long")


def source_key(source: Column) -> Column:
    """Sorts like the source, null last, and is never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("t"))


def _exact(x: Column) -> Column:
    return F.sum(F.round(x, 3).cast("decimal(38,3)")).cast("double")


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` as a table with ``number``, their place from 0 in the order; no task sees all of them."""
    held = rows.orderBy(order).withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()})
    held = table(held, "numbered")
    # As many rows as the sort had partitions.
    counts = sorted((r["_part"], r["count"]) for r in held.groupBy("_part").count().collect())
    before = {part: sum(n for _, n in counts[:k]) for k, (part, _) in enumerate(counts)}
    offsets = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.create_map(F.lit(0), F.lit(0))
    # The low 33 bits count the rows of a partition.
    inner = F.col("_place").bitwiseAND((1 << 33) - 1)
    return held.withColumn("number", inner + F.element_at(offsets, F.col("_part"))).drop("_part", "_place")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """skey, source_size, n, target from the per-source totals (skey, source_size, n).

    All sources but those at ``most`` times their size get the same tokens a unit of weight.  Each round takes
    this level from what the stopped sources leave and stops those that it would bring above; it rises from
    round to round, and the rounds end when none stops.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = numbered(sizes, "skey").withColumn("w", F.element_at(cycle, (F.col("number") % len(weights) + 1).cast("int")))
    limit, most_of = most * F.col("source_size") / F.col("w"), most * F.col("source_size")
    level, stopped = float("-inf"), -1
    while True:
        full = limit <= level
        sums = ranked.agg(
            F.count_if(full).alias("n"), F.sum("source_size").alias("whole"), F.sum(F.when(full, most_of)).alias("taken"),
            F.sum(F.when(~full, F.col("w"))).alias("w")
        ).first()
        if sums.n == stopped or not sums.w:
            break
        level, stopped = ((sums.whole or 0) - (sums.taken or 0)) / sums.w, sums.n
    target = F.when(limit <= level, most_of).otherwise(F.lit(max(level, 0.0)) * F.col("w"))
    return ranked.select("skey", "source_size", "n", target.cast("double").alias("target"))


def balance(counts: DataFrame, goal: DataFrame, most: int = 3, rounds: int = 80, tolerance: float = 1e-7) -> DataFrame:
    """goal with lam, the multiplier of each source; counts is (skey, size, n) over the corpus.

    One row per source is kept between rounds, in the shared folder.  Raises if ``rounds`` do not meet the constraints.
    """
    mean = F.try_divide("source_size", "n")
    ratio = F.try_divide("target", "source_size")
    open_ = (F.col("source_size") > 0) & (ratio < most * (1 - 1e-9)) & (ratio > 0)
    state = goal.withColumns(
        {
            "mean": mean, "open": F.coalesce(open_, F.lit(False)),
            "lam": F.coalesce(F.when(open_, F.log(ratio)), F.lit(0.0)), "low": F.lit(-1e5), "high": F.lit(1e5)
        }
    )
    state = table(state, "state")
    for _ in range(rounds):
        x = F.try_divide("size", "mean")
        tilt = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
        value = F.col("m") * F.col("size") * F.least(F.lit(float(most)), tilt)
        slope = F.when(tilt < most, F.col("m") * F.col("size") * x * tilt).otherwise(0.0)
        sums = counts.join(state.where("open"), "skey").groupBy("skey").agg(_exact(value).alias("value"), _exact(slope).alias("slope"))
        miss = F.col("value") - F.col("target")
        low, high = F.when(miss < 0, F.col("lam")).otherwise(F.col("low")), F.when(miss > 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - miss / F.nullif("slope", F.lit(0.0))
        step = F.when((newton > low) & (newton < high), newton).otherwise((low + high) / 2)
        done = F.coalesce((F.abs(miss) <= F.greatest(tolerance * F.col("target"), F.lit(0.01))) | (F.col("high") - F.col("low") < 1e-10), F.lit(True))
        before = state
        moved = state.join(sums, "skey", "left").select(
            "skey", "source_size", "n", "target", "mean", (F.col("open") & ~done).alias("open"),
            F.when(done, F.col("lam")).otherwise(step).alias("lam"),
            F.when(F.col("open"), low).otherwise(F.col("low")).alias("low"),
            F.when(F.col("open"), high).otherwise(F.col("high")).alias("high")
        )
        state = table(moved, "state")
        forget(before)
        if state.where("open").isEmpty():
            return state.select("skey", "source_size", "n", "target", "mean", F.round("lam", 9).alias("lam"))
    raise RuntimeError(f"entropy balancing did not converge in {rounds} rounds")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, block_rows: int = 512, row: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for every document.

    ``row`` names a column that tells apart rows with one doc_id; it comes first in the result.
    """
    key = [row or "doc_id"]
    sized = table(docs.select(*key, source_key(F.col("source")).alias("skey"), word_count(F.col("text")).alias("size")), "sized")
    counts = table(sized.groupBy("skey", "size").agg(F.count("*").alias("m")), "counts")
    sizes = counts.groupBy("skey").agg(F.sum(F.col("m") * F.col("size")).alias("source_size"), F.sum("m").alias("n"))
    state = balance(counts, targets(sizes, weights, most), most)

    ratio = F.try_divide("target", "source_size")
    tilt = F.least(F.lit(float(most)), F.exp(F.least(F.col("lam") * F.try_divide("size", "mean"), F.lit(50.0))))
    rate = F.when(ratio >= most * (1 - 1e-9), F.lit(float(most))).when(ratio <= 0, 0.0).otherwise(tilt)
    # Rows that agree in source, id and size are one entry of m rows, so no block grows with them.
    entries = sized.groupBy("skey", *key, "size").agg(F.count("*").alias("m"))
    rated = entries.join(state, "skey").withColumn("rate", F.coalesce(rate, F.lit(1.0)))
    rated = rated.withColumn("block", F.pmod(F.xxhash64(*key, "size"), F.ceil(F.col("n") / block_rows)))
    one = F.struct((-F.col("size")).alias("order"), F.col(key[0]).alias("key"), "size", "rate", "m")
    grouped = rated.groupBy("skey", "block").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.array_sort(F.collect_list(one)).alias("rows")
    )

    def step(acc: Column, x: Column) -> Column:
        want = x["rate"] * x["size"] * x["m"] + acc["carry"]
        copies = F.when(x["size"] > 0, F.greatest(F.lit(0), F.least(most * x["m"], F.floor(want / x["size"] + 0.5)))).otherwise(x["m"])
        entry = F.struct(x["key"].alias("key"), x["size"].alias("size"), x["m"].alias("m"), copies.cast("bigint").alias("copies"))
        return F.struct((want - copies * x["size"]).alias("carry"), F.concat(acc["out"], F.array(entry)).alias("out"))

    kind = dict(sized.dtypes)[key[0]]
    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast(f"array<struct<key:{kind},size:bigint,m:bigint,copies:bigint>>").alias("out"))
    placed = grouped.select("source_size", "target", F.explode(F.aggregate("rows", start, step, lambda acc: acc["out"])).alias("x"))
    # The entry's copies go round its m rows.
    each = placed.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("x.m"))).alias("i"))
    own = F.floor(F.col("x.copies") / F.col("x.m")) + F.when(F.col("i") <= F.col("x.copies") % F.col("x.m"), 1).otherwise(0)
    return each.select(
        F.col("x.key").alias(key[0]), "x.size", "source_size", "target", own.cast("int").alias("copies"),
        (own * F.col("x.size")).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """The documents themselves, each row as often as the mix takes it; the input's columns stay, null and repeated ids included."""
    held = table(docs.withColumn("_row", F.monotonically_increasing_id()), "mixed")
    copies = mix_sources(held, weights, most, row="_row").where("copies > 0").select("_row", "copies")
    times = copies.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return held.join(times.select("_row"), "_row").select(*[F.col(f"`{c}`") for c in docs.columns])
