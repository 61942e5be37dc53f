"""Repeated windows of a fixed length over all documents: what operators 8 and 9 share.

Documents with one text are one text here: ``distinct_texts`` names texts by
content and keeps the rows (id, text, how often) beside them, so a large group
of exact copies is one text from the start.

A text is a sequence of elements (bytes or words); a window is ``width``
consecutive ones.  Every window is assigned to an anchor, the position of least
priority among some inside the window; priorities depend only on what stands
near the position inside the window, so equal windows have anchors at the same
place and every window can be named relative to its anchor.  The windows of one
anchor are consecutive.

``Candidates.live`` drops what cannot be repeated: an anchor whose ``k``, the
fingerprint of the elements that any window of it has, comes nowhere else.  What
is left of a text are its live segments, a small part of it, and all that
follows works on these.  ``Candidates.find`` says where repeats are.  Each level
names groups of windows by ``k`` and by ``f``, the fingerprint of all elements
that the group covers: a group whose ``k`` is in no other segment is dropped; a
group whose ``f`` is in another segment is a candidate as a whole; groups with a
common ``k`` but several ``f`` go to the next, finer level, each distinct ``f``
once, from the first segment that has it.  The last level is single windows.
Equal contents always have equal fingerprints, so nothing repeated is dropped;
that candidates are equal is then verified on their content by the operators.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, arrow_map, forget, mix, span_hash, table


@dataclass(frozen=True)
class Elements:
    """The elements of a chunk of texts: prefix sums for span hashes, text bounds, priorities."""

    prefix: np.ndarray
    at: np.ndarray
    priority: np.ndarray


@dataclass(frozen=True)
class Plan:
    """width: elements of a window; an anchor lies low..high-1 after the window's start; block: starts per group at the middle level (0: none)."""

    width: int
    low: int
    high: int
    block: int


#: Fingerprints and the row of the text that each belongs to.
Pairs = tuple[np.ndarray, np.ndarray]


class Groups:
    """Anchors of a chunk with their windows: position, text, first and last window start."""

    def __init__(self, elements: Elements, plan: Plan):
        self.e, self.plan = elements, plan
        at, n = elements.at, elements.prefix.shape[1] - 1
        total = n - plan.width + 1
        if total <= 0:
            self.a = self.doc = self.s0 = self.s1 = np.zeros(0, np.int64)
            return
        place = least_places(elements.priority, plan.high - plan.low)[plan.low : plan.low + total]
        doc_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
        start = np.flatnonzero(doc_of[:total] == doc_of[plan.width - 1 : plan.width - 1 + total])
        a, d = place[start], doc_of[start]
        new = np.ones(len(start), bool)
        new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        self.a, self.doc, self.s0, self.s1 = a[first], d[first], start[first], start[last] if len(first) else start[:0]

    def _named(self, row, smin, smax, s0, s1):
        """k of any windows that start in smin..smax and f of the windows s0..s1, for the anchors ``row``."""
        p, a, stop = self.e.prefix, self.a[row], s1 + self.plan.width
        f = mix(span_hash(p, s0, stop) + (a - s0).astype(U64) * U64(0x9E3779B97F4A7C15) + (stop - a).astype(U64) * U64(0xC2B2AE3D27D4EB4F))
        return span_hash(p, smax, smin + self.plan.width), f

    def anchors(self):
        row = np.arange(len(self.a))
        return row, self.s0, self.s1, *self._named(row, self.a - self.plan.high + 1, self.a - self.plan.low, self.s0, self.s1)

    def blocks(self, chosen: np.ndarray):
        """The chosen anchors' groups of ``block`` starts, counted from the anchor: anchor, first and last window, k, f."""
        size, top = self.plan.block, self.a[chosen] - self.plan.low
        b0, b1 = (top - self.s1[chosen]) // size, (top - self.s0[chosen]) // size
        row, b = expand(chosen, b0, b1)
        smax = self.a[row] - self.plan.low - size * b
        smin = smax - size + 1
        s0, s1 = np.maximum(smin, self.s0[row]), np.minimum(smax, self.s1[row])
        return row, s0, s1, *self._named(row, smin, smax, s0, s1)

    def windows(self, row: np.ndarray, s0: np.ndarray, s1: np.ndarray):
        """Start, text and fingerprint of every window s0..s1 of the anchors ``row``."""
        which, s = expand(np.arange(len(row)), s0, s1)
        return s, self.doc[row[which]], span_hash(self.e.prefix, s, s + self.plan.width)

    def claimed(self, wanted: Pairs, opened: Pairs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first and last window of the groups and windows wanted; those opened are looked into."""
        row, s0, s1, _, f = self.anchors()
        out = []
        for block in range(2 if self.plan.block else 1):
            if block:
                row, s0, s1, _, f = self.blocks(row)
            hit, further = within(f, self.doc[row], *wanted), within(f, self.doc[row], *opened)
            out.append((self.doc[row[hit]], s0[hit], s1[hit]))
            row, s0, s1 = row[further], s0[further], s1[further]
        s, doc, w = self.windows(row, s0, s1)
        hit = within(w, doc, *wanted)
        out.append((doc[hit], s[hit], s[hit]))
        return tuple(np.concatenate(part) for part in zip(*out, strict=True))

    def repeated_anchors(self) -> np.ndarray:
        """Anchors whose k comes twice in their text, but for the first of each."""
        _, _, _, k, _ = self.anchors()
        key = k ^ mix(self.doc.astype(U64) + U64(1))
        order = np.argsort(key, kind="stable")
        return order[1:][key[order][1:] == key[order][:-1]]

    def own_repeats(self, equal: Callable[[int, int, int], bool]) -> list[tuple[int, int, int]]:
        """Runs (s, t, n): the n windows from s on equal those from t > s on in the same text.

        Windows meet where an anchor's k comes twice in a text; of equal windows each meets the next.
        ``equal(s, t, n)`` verifies n elements on their content.
        """
        row, s0, s1, k, _ = self.anchors()
        key = k ^ mix(self.doc.astype(U64) + U64(1))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        suspect = np.zeros(len(key), bool)
        suspect[order[1:][same]] = suspect[order[:-1][same]] = True
        s, doc, w = self.windows(row[suspect], s0[suspect], s1[suspect])
        key = w ^ mix(doc.astype(U64) + U64(1))
        order = np.argsort(key, kind="stable")
        same = np.flatnonzero(key[order][1:] == key[order][:-1])
        one, two = s[order[same]], s[order[same + 1]]
        if not len(one):
            return []
        by = np.lexsort((one, two - one))
        one, two = one[by], two[by]
        new = np.flatnonzero(np.concatenate(([True], (np.diff(one) != 1) | (np.diff(two) != 1))))
        out = []
        for first, stop in zip(new.tolist(), [*new[1:].tolist(), len(one)], strict=True):
            a, b, n = int(one[first]), int(two[first]), stop - first
            if equal(a, b, n + self.plan.width - 1):
                out.append((a, b, n))
            else:  # a fingerprint of some window deceives: each window by itself
                out += [(a + j, b + j, 1) for j in range(n) if equal(a + j, b + j, self.plan.width)]
        return out


def expand(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row repeated for every number first..last, with the number."""
    n = last - first + 1
    begin = np.cumsum(n) - n
    return np.repeat(row, n), np.arange(n.sum()) - np.repeat(begin - first, n)


def least_places(priority: np.ndarray, span: int) -> np.ndarray:
    """Where the least priority of each ``span`` neighbours from i on is; of equal ones the first."""
    n = len(priority)
    value, place, size = priority, np.arange(n), 1
    while size < span:
        step = min(size, span - size)
        take = value[step:] < value[: len(value) - step]
        value = np.where(take, value[step:], value[: len(value) - step])
        place = np.where(take, place[step:], place[: len(place) - step])
        size += step
    return np.concatenate((place, np.full(n - len(place), n - 1)))


def within(keys: np.ndarray, doc: np.ndarray, wanted: np.ndarray, wanted_doc: np.ndarray) -> np.ndarray:
    """Which (text, key) pairs are among the wanted ones."""
    return np.isin(keys ^ mix(doc.astype(U64) + U64(1)), wanted ^ mix(wanted_doc.astype(U64) + U64(1)))


def lists(column) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a list column and the row of each (a null list is empty)."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)


def with_list(texts: DataFrame, rows: DataFrame, column: str, how: str = "inner") -> DataFrame:
    """Texts (id, text) with a list of what ``rows`` has for their id."""
    per = rows.groupBy("id").agg(F.collect_list(column).alias(column))
    return texts.join(per, "id", how)


def distinct_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, id, first, total) of the distinct rows and (id, text) of the distinct texts.

    n counts the rows with this doc_id and text.  A text's ``id`` is in the order of the smallest doc_id
    that has it (``first``; null, so last, if none has an id), then of its content; ``total`` counts its rows.
    """
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    blob = F.unhex(F.sha2(text, 256)).alias("blob")
    members = table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), blob).groupBy("doc_id", "blob").agg(F.count("*").alias("n")), "members")
    firsts = members.groupBy("blob").agg(F.min("doc_id").alias("first"), F.sum("n").alias("total"))
    ids = table(firsts.orderBy(F.col("first").asc_nulls_last(), "blob").withColumn("id", F.monotonically_increasing_id()), "ids")
    texts = docs.select(blob, text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    texts = table(texts.join(ids.select("blob", "id"), "blob").select("id", "text"), "texts")
    rows = table(members.join(ids, "blob").drop("blob"), "rows")
    forget(members, ids)
    return rows, texts


class Candidates:
    """``read`` makes Elements from a binary column; ``cut(text, first, last)`` gives elements first..last-1 of a text as a text."""

    def __init__(self, plan: Plan, read: Callable[..., Elements], cut: Callable[[bytes, np.ndarray], list[bytes]]):
        self.plan, self.read, self.cut = plan, read, cut

    def groups(self, column) -> Groups:
        return Groups(self.read(column), self.plan)

    def live(self, texts: DataFrame) -> DataFrame:
        """sid, id, start, text: the stretches of texts (id, text) that windows cover whose k comes twice; sid is in the order of id and start."""

        def keys(batch):
            groups, ids = self.groups(batch.column(1)), batch.column(0).to_numpy()
            _, _, _, k, _ = groups.anchors()
            once = np.unique(k ^ mix(groups.doc.astype(U64) + U64(1)), return_index=True)[1]
            again = groups.repeated_anchors()
            # A k that a text has twice counts as if another text had it too.
            every, of = np.concatenate((k[once], k[again])), np.concatenate((ids[groups.doc[once]], -1 - ids[groups.doc[again]]))
            return {"k": pa.array(every.view(np.int64)), "id": pa.array(of)}

        rows = table(arrow_map(texts, "k long, id long", keys), "keys")
        shared = table(rows.groupBy("k").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("k"), "shared")
        held = table(rows.where("id >= 0").join(shared, "k"), "live")

        def segments(batch):
            groups, ids = self.groups(batch.column(1)), batch.column(0).to_numpy()
            _, s0, s1, k, _ = groups.anchors()
            hit = within(k, groups.doc, *wanted_of(batch))
            cover, at = np.zeros(groups.e.prefix.shape[1], np.int64), groups.e.at
            np.add.at(cover, s0[hit], 1)
            np.add.at(cover, s1[hit] + self.plan.width, -1)
            on = np.cumsum(cover[:-1]) > 0
            inner = np.ones(len(on) + 1, bool)
            inner[at] = False  # segments end with their text
            first = np.flatnonzero(on & ~(np.concatenate(([False], on[:-1])) & inner[:-1]))
            last = np.flatnonzero(on & ~(np.concatenate((on[1:], [False])) & inner[1:])) + 1
            doc = np.searchsorted(at, first, side="right") - 1
            parts = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                here = doc == row if batch.num_rows > 1 else slice(None)
                parts += self.cut(text, np.column_stack((first[here], last[here])) - at[row])
            return {"id": pa.array(ids[doc]), "start": pa.array(first - at[doc]), "text": pa.array(parts, pa.binary())}

        cut = arrow_map(with_list(texts, held.withColumnRenamed("k", "f"), "f"), "id long, start long, text binary", segments)
        cut = table(cut, "cut")  # the sort reads its input twice
        out = table(cut.orderBy("id", "start").select(F.monotonically_increasing_id().alias("sid"), "id", "start", "text"), "segments")
        forget(rows, shared, held, cut)
        return out

    def _rows(self, texts: DataFrame, emit) -> DataFrame:
        def run(batch):
            groups = self.groups(batch.column(1))
            k, f, doc = emit(groups, batch)
            # A text that repeats a group has one row of it.
            once = np.unique(mix(f) ^ mix(doc.astype(U64) + U64(1)), return_index=True)[1]
            ids = batch.column(0).to_numpy()
            yield {"k": pa.array(k[once].view(np.int64)), "f": pa.array(f[once].view(np.int64)), "id": pa.array(ids[doc[once]])}
            if batch.num_columns == 2:  # the first level: texts that repeat something of their own have a row without k
                own = ids[np.unique(groups.doc[groups.repeated_anchors()])]
                yield {"k": pa.nulls(len(own), pa.int64()), "f": pa.nulls(len(own), pa.int64()), "id": pa.array(own)}

        return arrow_map(texts, "k long, f long, id long", run)

    def _settle(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(id, f) of groups that other texts hold whole, and (id, f) of those to look into; ``rows`` is deleted."""
        # Tables of their own: a join's two sides both shuffle then, and Spark can split a frequent key.
        shared = table(rows.groupBy("k").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("k"), "keys")
        live = table(rows.join(shared, "k"), "shared")
        whole = table(live.groupBy("k", "f").agg(F.min("id").alias("first"), F.max("id").alias("last")), "whole")
        several = table(whole.groupBy("k").agg(F.min("f").alias("x"), F.max("f").alias("y")).where("x <> y").select("k"), "several")
        found = table(live.select("f", "id").join(whole.where("first <> last").select("f"), "f").select("id", "f"), "found")
        open_ = table(whole.join(several, "k").select(F.col("first").alias("id"), "f"), "open")
        forget(rows, shared, live, whole, several)
        return found, open_

    def find(self, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(id, f, opened): the groups and windows that seem to be in another text too, and those looked into for smaller ones; (id) of texts that may repeat something of their own."""
        plan = self.plan

        def first_level(groups, batch):
            row, _, _, k, f = groups.anchors()
            return k, f, groups.doc[row]

        def middle_level(groups, batch):
            row, _, _, _, f = groups.anchors()
            row, _, _, k, f = groups.blocks(row[within(f, groups.doc, *wanted_of(batch))])
            return k, f, groups.doc[row]

        def last_level(groups, batch):
            row, s0, s1, _, f = groups.blocks(np.arange(len(groups.a))) if plan.block else groups.anchors()
            keep = within(f, groups.doc[row], *wanted_of(batch))
            _, doc, w = groups.windows(row[keep], s0[keep], s1[keep])
            return w, w, doc

        groups = table(self._rows(texts, first_level), "groups")
        own = table(groups.where("k IS NULL").select("id"), "own")
        found, open_ = self._settle(groups)
        opened = open_
        if plan.block:
            more, open_ = self._settle(table(self._rows(with_list(texts, open_, "f"), middle_level), "groups"))
            found, opened = found.union(more), opened.union(open_)
        rows = table(self._rows(with_list(texts, open_, "f"), last_level).select("f", "id"), "windows")
        twice = table(rows.groupBy("f").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select("f"), "twice")
        found = found.union(table(rows.join(twice, "f").select("id", "f"), "found"))
        forget(rows, twice)
        return found.withColumn("opened", F.lit(False)).union(opened.withColumn("opened", F.lit(True))), own

    def spans(self, texts: DataFrame, schema: str, emit) -> tuple[DataFrame, DataFrame]:
        """What ``emit(batch, groups, text, first and last window)`` makes of the candidates in texts (id, text), wherever they stand; (id) as of ``find``."""

        def run(batch):
            groups = self.groups(batch.column(1))
            return emit(batch, groups, *groups.claimed(wanted_of(batch), wanted_of(batch, 3)))

        claims, own = self.find(texts)
        per = claims.groupBy("id").agg(
            F.collect_list(F.when(~F.col("opened"), F.col("f"))).alias("f"),
            F.collect_list(F.when(F.col("opened"), F.col("f"))).alias("open")
        )
        return arrow_map(texts.join(per.where(F.size("f") > 0), "id"), schema, run), own


def wanted_of(batch, column: int = 2) -> Pairs:
    f, of = lists(batch.column(column))
    return f.view(U64), of
