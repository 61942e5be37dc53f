"""Substring deduplication: bytes (operator 8) and words (operator 9).

``remove_repeated_bytes`` takes out every byte that a repeated 400-byte string
covers, all occurrences alike, by a sparse suffix array (``suffixes``).  Only
suffixes that may be repeated enter it: ``repeats`` drops the windows whose
neighbourhood is in no other text and lets one suffix stand for consecutive
windows.  Which suffixes are repeated is read off the array, from the common
prefixes of neighbours, on the bytes themselves.

``remove_repeated_words`` takes out every word that a 20-word window covers
whose words stand earlier (smaller doc_id, or earlier in the document).
Recompression names the words: in each round runs of one symbol get a name,
then neighbouring symbols are joined where a coin thrown on the left symbol's
name shows one side and on the right symbol's the other.  Equal passages get
the same symbols but for a few at their ends; shared symbols inside windows
reveal repeats, and these are then verified on their words.

Defined cases of both: null text is the empty text; every row is a document of
its own, also rows that share a doc_id or have none; an empty table gives no
rows; further columns are ignored.  Order for words: by doc_id, null last, then
by content; of rows equal in both, one is the first.
"""

from __future__ import annotations

import hashlib
import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, U64, arrow_map, byte_prefix, flat, mix, prefix_hash, seeds, sliding_hash, span_hash, table, words
from .repeats import Candidates, Elements, Groups, Plan, distinct_texts, lists, with_list
from .suffixes import SUFFIX, repeated_suffixes

_LAST = U64(0xFFFFFFFFFFFFFFFF)
_GRAM = 32
_EMPTY = hashlib.sha256(b"").hexdigest()


def sha256(parts) -> pa.Array:
    return pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string())


def _bytes(column) -> Elements:
    data, at = flat(column)
    prefix = byte_prefix(data)
    priority = np.full(len(data), _LAST)
    grams = sliding_hash(prefix, _GRAM)
    priority[: len(grams)] = grams
    return Elements(prefix, at, priority)


#: Longest span that one packed number says.
_LONGEST = 1 << 23


def _own_spans(segments: DataFrame, own: DataFrame, plan: Plan, read, equal, both: bool) -> DataFrame:
    """id, start, need of what segments repeat within themselves; ``both``: the first of equal windows too."""

    def run(batch):
        elements, ids, start, need = read(batch.column(1)), [], [], []
        at, of = elements.at, batch.column(0).to_numpy()
        for s, t, n in Groups(elements, plan).own_repeats(equal(batch.column(1))):
            row = int(np.searchsorted(at, s, side="right")) - 1
            for x in (s, t) if both else (t,):
                for k in range(0, n, _LONGEST // 2):
                    ids.append(of[row])
                    start.append(x - at[row] + k)
                    need.append(min(n - k, _LONGEST // 2) + plan.width - 1)
        return {"id": pa.array(ids, pa.int64()), "start": pa.array(start, pa.int64()), "need": pa.array(need, pa.int64())}

    return arrow_map(segments.select(F.col("sid").alias("id"), "text").join(own, "id", "left_semi"), "id long, start long, need long", run)


def _removed(texts: DataFrame, segments: DataFrame, found: DataFrame) -> DataFrame:
    """Texts with the list ``spans`` (start << 24 | length, elements from the text's start) of what goes, given as (id, start, need) of segments."""
    placed = found.withColumnRenamed("start", "at").join(
        segments.select(F.col("sid"), F.col("id").alias("text_id"), "start"), F.col("id") == F.col("sid")
    )
    packed = placed.select(F.col("text_id").alias("id"), (F.shiftleft(F.col("start") + F.col("at"), 24) + F.col("need")).alias("spans"))
    return with_list(texts, table(packed, "spans"), "spans", "left")


def _covered(batch, at: np.ndarray) -> np.ndarray:
    """Which elements the batch's spans cover; ``at``: where each text's elements begin (one more for the end)."""
    spans, of = lists(batch.column(2))
    cover = np.zeros(int(at[-1]) + 1, np.int64)
    start = at[of] + (spans >> 24)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + (spans & 0xFFFFFF), -1)
    return np.cumsum(cover[:-1]) > 0


def _digest_bytes(data: np.ndarray, at: np.ndarray, removed: np.ndarray) -> dict:
    total = np.concatenate(([0], np.cumsum(removed)))
    begin = removed & ~np.concatenate(([False], removed[:-1]))
    begin[at[:-1][np.diff(at) > 0]] = removed[at[:-1][np.diff(at) > 0]]
    spans = np.concatenate(([0], np.cumsum(begin)))
    kept = [data[a:b][~removed[a:b]].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
    return {
        "n_bytes": pa.array(np.diff(at)), "n_removed": pa.array(total[at[1:]] - total[at[:-1]]),
        "n_spans": pa.array(spans[at[1:]] - spans[at[:-1]]), "kept_sha256": sha256(kept)
    }


def _cut_bytes(text: bytes, bounds: np.ndarray) -> list[bytes]:
    return [text[a:b] for a, b in bounds.tolist()]


def repeated_byte_spans(segments: DataFrame, candidates: Candidates) -> DataFrame:
    """id, start, need of strings of at least the plan's width in segments (sid, text) that stand somewhere else too."""
    plan = candidates.plan

    def cut(batch, groups, doc, s0, s1):
        data, at = flat(batch.column(1))
        ids, whole = batch.column(0).to_numpy(), memoryview(data)
        stop = s1 + plan.width
        size = np.cumsum(stop - s0)
        for first in range(0, int(size[-1]) if len(size) else 0, CHUNK_BYTES):
            a, b = np.searchsorted(size, [first, first + CHUNK_BYTES], side="right")
            if a < b:
                s = [bytes(whole[i:j]) for i, j in zip(s0[a:b].tolist(), stop[a:b].tolist(), strict=True)]
                yield {"id": pa.array(ids[doc[a:b]]), "start": pa.array(s0[a:b] - at[doc[a:b]]), "s": pa.array(s, pa.binary())}

    def equal(column):
        data, _ = flat(column)
        return lambda a, b, m: np.array_equal(data[a : a + m], data[b : b + m])

    found, own = candidates.spans(segments.select(F.col("sid").alias("id"), "text"), SUFFIX, cut)
    return repeated_suffixes(table(found, "candidates")).union(_own_spans(segments, own, plan, candidates.read, equal, both=True))


def remove_repeated_bytes(docs: DataFrame, width: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; ``width`` is at least 48."""
    low = (width - _GRAM) // 5
    candidates = Candidates(Plan(width, low, width - max(low, _GRAM - 1), 16), _bytes, _cut_bytes)
    rows, texts = distinct_texts(docs)
    segments = candidates.live(texts)
    spanned = _removed(texts, segments, repeated_byte_spans(segments, candidates))

    def finish(batch):
        data, at = flat(batch.column(1))
        return {"id": batch.column(0)} | _digest_bytes(data, at, _covered(batch, at))

    digest = arrow_map(spanned, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", finish)
    # Of a text that several rows have, every string of the width is repeated.
    copied = (F.col("total") > 1) & (F.col("n_bytes") >= width)
    whole = {"n_removed": F.col("n_bytes"), "n_spans": F.lit(1).cast("long"), "kept_sha256": F.lit(_EMPTY)}
    out = rows.join(digest, "id").withColumns({c: F.when(copied, v).otherwise(F.col(c)) for c, v in whole.items()})
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("n")))).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@dataclass(frozen=True)
class Symbols:
    """Symbols of a chunk after a round: their first word, their name and, of a run or pair, what it is made of."""

    start: np.ndarray
    name: np.ndarray
    kind: np.ndarray  # 0 taken over, 1 a run (left: the symbol, right: how often), 2 a pair (left, right)
    left: np.ndarray
    right: np.ndarray


def recompress(symbols: Symbols, edge: np.ndarray, salt: int, pairs: bool) -> Symbols:
    """One round: runs of a symbol get a name, or neighbours are paired where a coin thrown on their names shows one side, then the other.

    Names are fingerprints of the parts, so a run or pair has one name wherever it is named.
    """
    start, names = symbols.start, symbols.name
    n = len(names)
    fits = ~edge[start[1:]]
    a, b, c = seeds(3, salt)
    if pairs:
        coin = (mix(names ^ a) & U64(1)).astype(bool)
        first = np.zeros(n, bool)
        first[:-1] = coin[:-1] & ~coin[1:] & fits
        kept = ~np.concatenate(([False], first[:-1])) if n else first
        right = np.concatenate((names[1:], names[:1]))
    else:
        kept = np.concatenate(([True], (names[1:] != names[:-1]) | ~fits)) if n else np.zeros(0, bool)
        size = np.diff(np.append(np.flatnonzero(kept), n))
        first, right = np.zeros(n, bool), np.zeros(n, U64)
        first[kept], right[kept] = size > 1, size
    new = np.where(first, mix(names * b + right * c + a), names)[kept]
    return Symbols(start[kept], new, (1 + pairs) * first[kept], names[kept], right[kept])


#: Words before and after an anchor that settle it.
_QUIET = 6
#: Rounds over words: runs and pairs, then runs and pairs of what these made.
ROUNDS = ((False, 51), (True, 52), (False, 53), (True, 54))


def _parsed(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[Symbols]]:
    """Word names, their prefix sums, where each text's words begin and the symbols after each round."""
    data, at = flat(column)
    start, stop, first = words(data, at)
    codes = span_hash(byte_prefix(data), start, stop)
    edge = np.zeros(len(codes) + 1, bool)
    edge[first] = True
    zero = np.zeros(len(codes), np.int64)
    rounds = [Symbols(np.arange(len(codes)), codes, zero, codes, codes)]
    for pairs, salt in ROUNDS:
        rounds.append(recompress(rounds[-1], edge, salt, pairs))
    return codes, prefix_hash(codes), first, rounds


def _plain_words(column) -> Elements:
    """Any place may be an anchor: the least by four words about it."""
    data, at = flat(column)
    start, stop, first = words(data, at)
    prefix = prefix_hash(span_hash(byte_prefix(data), start, stop))
    priority = np.full(len(start), _LAST)
    grams = sliding_hash(prefix, 4)
    priority[2 : 2 + len(grams)] = grams
    return Elements(prefix, first, priority)


def _words(column) -> Elements:
    """Anchors are where a last symbol begins, unless words or symbols near it repeat.

    A run may go on outside a window and its name says how long it is.  Where none of the ``_QUIET`` words
    before and after a place equals its neighbour, nor any of the two symbols before and after it after the
    second round, all that decides whether a symbol begins there stands in these words.
    """
    codes, prefix, first, rounds = _parsed(column)
    n = len(codes)
    near = np.zeros(n + 1, np.int64)
    near[1:] = np.cumsum(np.concatenate((codes[1:] == codes[:-1], [False]))) if n else 0
    place = rounds[-1].start
    place = place[(place >= _QUIET) & (place + _QUIET <= n)]
    quiet = near[place + _QUIET - 1] == near[place - _QUIET]
    second = rounds[2]
    same = np.concatenate(([0], np.cumsum(np.concatenate((second.name[1:] == second.name[:-1], [False]))))) if n else np.zeros(1, np.int64)
    j = np.searchsorted(second.start, place)
    quiet &= same[np.minimum(j + 1, len(same) - 1)] == same[np.maximum(j - 2, 0)]
    place = place[quiet]
    priority = np.full(n, _LAST)
    priority[place] = span_hash(prefix, place - 2, place + 2)
    return Elements(prefix, first, priority)


def symbol_names(segments: DataFrame) -> DataFrame:
    """The global names of all rounds over all segments (sid, text): round, name, low and high, and how often it was given.

    Round 0 names words.  low and high are the least and the greatest fingerprint, by other constants, of what a
    name stands for: they are equal unless names clash.
    """

    def named(batch):
        _, _, _, rounds = _parsed(batch.column(1))
        own = list({w: None for t in batch.column(1).to_pylist() for w in t.split()})
        word_column = pa.array([b" ".join(own)], pa.binary())
        found = [(np.zeros(len(own), np.int64), _parsed(word_column)[0], np.frombuffer(b"".join([hashlib.sha256(w).digest()[:8] for w in own]), U64))]
        b, c = seeds(2, 61)
        for k, x in enumerate(rounds[1:], 1):
            made = x.kind > 0
            parts = mix(x.left[made] * b + x.right[made] * c + x.kind[made].astype(U64))
            once = np.unique(x.name[made] ^ mix(parts), return_index=True)[1]
            found.append((np.full(len(once), k), x.name[made][once], parts[once]))
        round_, name, parts = (np.concatenate(column) for column in zip(*found, strict=True))
        return {"round": pa.array(round_, pa.int32()), "name": pa.array(name.view(np.int64)), "parts": pa.array(parts.view(np.int64))}

    rows = arrow_map(segments.select("sid", "text"), "round int, name long, parts long", named)
    return rows.groupBy("round", "name").agg(F.min("parts").alias("low"), F.max("parts").alias("high"), F.count("*").alias("n"))


def name_clashes(names: DataFrame) -> int:
    """How many names of ``symbol_names`` stand for different things."""
    return names.where("low <> high").count()


def _cut_words(text: bytes, bounds: np.ndarray) -> list[bytes]:
    own = text.split()
    return [b" ".join(own[a:b]) for a, b in bounds.tolist()]


def _digest_words(texts: list[list[bytes]], first: np.ndarray, removed: np.ndarray) -> dict:
    total = np.concatenate(([0], np.cumsum(removed)))
    kept = []
    for row, own in enumerate(texts):
        gone = removed[first[row] : first[row + 1]]
        kept.append(b" ".join([w for w, g in zip(own, gone.tolist(), strict=True) if not g] if gone.any() else own))
    return {"n_words": pa.array(np.diff(first)), "n_removed": pa.array(total[first[1:]] - total[first[:-1]]), "kept_sha256": sha256(kept)}


def repeated_word_spans(segments: DataFrame, candidates: Candidates) -> DataFrame:
    """id, start, need of word sequences in segments (sid, text) that a segment with a smaller sid, or the same one earlier, holds too.

    Sequences are compared by the SHA-256 of their words.
    """
    plan = candidates.plan

    def name(batch, groups, doc, s0, s1):
        own = [w for t in batch.column(1).to_pylist() for w in t.split()]
        digest = b"".join([hashlib.sha256(b" ".join(own[a:b])).digest()[:16] for a, b in zip(s0.tolist(), (s1 + plan.width).tolist(), strict=True)])
        both = np.frombuffer(digest, np.int64).reshape(-1, 2)
        return {
            "d1": pa.array(both[:, 0]), "d2": pa.array(both[:, 1]), "id": pa.array(batch.column(0).to_numpy()[doc]),
            "start": pa.array(s0 - groups.e.at[doc]), "need": pa.array(s1 - s0 + plan.width)
        }

    def equal(column):
        own = [w for t in column.to_pylist() for w in t.split()]
        return lambda a, b, m: own[a : a + m] == own[b : b + m]

    found, own = candidates.spans(segments.select(F.col("sid").alias("id"), "text"), "d1 long, d2 long, id long, start long, need long", name)
    named = table(found, "named")
    firsts = table(
        named.groupBy("d1", "d2").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("d1", "d2", "low"),
        "firsts"
    )
    later = named.join(firsts, ["d1", "d2"]).where("id <> low").select("id", "start", "need")
    return later.union(_own_spans(segments, own, plan, candidates.read, equal, both=False))


def remove_repeated_words(docs: DataFrame, width: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    candidates = Candidates(Plan(width, _QUIET, width - _QUIET + 1, 0), _words, _cut_words)
    rows, texts = distinct_texts(docs)
    # Which stretches can hold repeats is told by plain words, so that only these are parsed.
    segments = Candidates(Plan(width, 4, width - 3, 0), _plain_words, _cut_words).live(texts)
    if clashes := name_clashes(symbol_names(segments)):
        # Equal passages still have equal symbols; what a clash brings together the words tell apart.
        warnings.warn(f"{clashes} names stand for different words, runs or pairs", stacklevel=2)
    spanned = _removed(texts, segments, repeated_word_spans(segments, candidates))

    def finish(batch):
        own = [t.split() for t in batch.column(1).to_pylist()]
        first = np.concatenate(([0], np.cumsum([len(w) for w in own]))).astype(np.int64)
        return {"id": batch.column(0)} | _digest_words(own, first, _covered(batch, first))

    digest = arrow_map(spanned, "id long, n_words long, n_removed long, kept_sha256 string", finish)
    out = rows.join(digest, "id").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    # A text's first row stands; every window of its later rows stands earlier.
    again = ((F.col("_copy") > 1) | ~F.col("doc_id").eqNullSafe(F.col("first"))) & (F.col("n_words") >= width)
    return out.select(
        "doc_id", "n_words", F.when(again, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(again, _EMPTY).otherwise(F.col("kept_sha256")).alias("kept_sha256")
    )
