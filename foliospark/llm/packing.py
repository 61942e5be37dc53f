"""Best-fit packing of token sequences by the sum-of-squares rule (operator 4).

Documents become token ids, ids become pieces of at most ``capacity`` tokens
(only longer documents are cut), and pieces are placed one after another into
the open bin that leaves the sum of squared counts of open bins per residual
gap smallest.  Pieces are dealt by hash to shards of about ``shard_rows``
pieces, so a shard's rows and open bins stay about the same at any input size;
each shard leaves at most a few bins open (the README states the loss).

Defined cases: a null or empty text is the single id 0; a null doc_id is kept
as it is; repeated rows are packed as often as they occur; an empty table gives
no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import json
import operator
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, arrow_map, seeds, table, text_bytes

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Entries that a worker's word cache takes before its older half goes; words in use move to the newer half.
CACHE_WORDS = 200_000
#: Characters, of two bytes at most, of the longest piece that is merged together with others; longer ones go through the model one by one.
PIECE_CHARS = 32
#: Pieces that are merged together, few enough for a processor's cache.
MERGED_AT_ONCE = 4096
#: Words whose ids are put together at once.
WORDS_AT_ONCE = 1 << 14
#: Bytes of text whose words are told apart at once; a longer text stays whole.
TEXT_BYTES = 1 << 20

# ASCII and the letters of Latin-1 and Latin Extended-A that have a one-letter lower case: there the
# tokenizer's normalisation is lower() and its pieces are these; other words go through the tokenizer itself.
# All are for words on a line each, whose line feeds are pieces too.
_ODD = re.compile(r"[^\x21-\x7EÀ-ÖØ-öø-įı-ž\n]")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^a-z0-9ß-öø-ž\n]+|\n")
#: Ends a word in joined ids. No id holds the byte 255 four times, nor do two that meet, as ids are below 2**24.
_END = b"\xff" * 4


def _without(words: list, found: list) -> list:
    """The words for which nothing was found."""
    return list(itertools.compress(words, map(operator.is_, found, itertools.repeat(None))))


class Merges:
    """The merges of a BPE, applied to many pieces at once: in each the pair of least rank, the leftmost of equals, until none is left."""

    NONE = np.int32(1 << 30)

    def __init__(self, model: dict, byte_char: list[str]):
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(model["merges"])}
        self.inner = np.array([vocab[c] for c in byte_char], np.int64)
        self.last = np.array([vocab[c + end] for c in byte_char], np.int64)
        self.size = max(vocab.values()) + 2  # one more for what stands about a piece
        self.merged = np.zeros(len(model["merges"]), np.int64)
        self.merged[list(pairs.values())] = [vocab[a + b] for a, b in pairs]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        entry = keys << 20 | np.array(list(pairs.values()), np.int64)
        self.tables: list[tuple[np.uint64, np.ndarray]] = []
        while len(entry):  # what finds its slot taken goes to the next table
            seed, table = seeds(1, 100 + len(self.tables))[0], np.full(1 << 17, -1, np.int64)
            used, first = np.unique(self._slot(entry >> 20, seed), return_index=True)
            table[used] = entry[first]
            self.tables.append((seed, table))
            entry = np.delete(entry, first)

    @classmethod
    def of(cls, tokenizer_path: str, byte_char: list[str]) -> Merges | None:
        """None if the model asks for more than merges, lacks some bytes or is larger than the tables hold."""
        with open(tokenizer_path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        more = ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")
        end = model.get("end_of_word_suffix") or ""
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in more) and len(model["vocab"]) < 1 << 20
        return cls(model, byte_char) if plain and all(c in model["vocab"] and c + end in model["vocab"] for c in byte_char) else None

    @staticmethod
    def _slot(keys: np.ndarray, seed) -> np.ndarray:
        return (keys.view(U64) * seed >> U64(47)).view(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.size + right
        found, at = np.full(len(keys), self.NONE), None
        for seed, table in self.tables:
            entry = table[self._slot(keys, seed)]
            hit, other = entry >> 20 == keys, np.flatnonzero((entry >> 20 != keys) & (entry >= 0))
            some = np.flatnonzero(hit)
            found[some if at is None else at[some]] = entry[some] & 0xFFFFF
            at, keys = other if at is None else at[other], keys[other]
            if not len(keys):
                break
        return found

    def __call__(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each of the pieces, which have 1 to 125 bytes, and best much the same number."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n, width = len(pieces), int(size.max()) + 2
        column = np.arange(width)
        # A row for each piece with a column before and, at least, one after it.
        inside = (column >= 1) & (column <= size[:, None])
        ids = np.full((n, width), self.size - 1, np.int32)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ids[inside] = self.inner[data]
        ids[np.arange(n), size] = self.last[data[np.cumsum(size) - 1]]
        rank = np.full((n, width), self.NONE)
        pair = inside[:, :-1] & inside[:, 1:]
        rank[:, :-1][pair] = self._rank(ids[:, :-1][pair], ids[:, 1:][pair])
        after, before = (np.broadcast_to(column + d, (n, width)).astype(np.int8).ravel() for d in (1, -1))
        flat, ranks, there = ids.ravel(), rank.ravel(), inside.ravel()
        rows = np.flatnonzero(size > 1)
        while len(rows):
            some = rank[rows]
            best = some.argmin(1)
            least = some[np.arange(len(rows)), best]
            go = np.flatnonzero(least < self.NONE)
            rows, best, least = rows[go], best[go], least[go]
            start = rows * width
            at = start + best
            gone = start + after[at]
            right, left = after[gone], before[at]
            flat[at] = made = self.merged[least]
            there[gone], ranks[gone] = False, self.NONE
            after[at] = right
            before[start + right] = best
            ranks[at] = self._rank(made, flat[start + right])
            ranks[start + left] = self._rank(flat[start + left], made)
        out = flat[there].astype("<u4").tobytes()
        stops = (4 * np.cumsum(there.reshape(n, width).sum(1))).tolist()
        return [out[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]


class WordTokenizer:
    """Ids of a lower-casing BPE whose tokens never cross white space, cached word by word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.special = re.compile("|".join(re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()) or "(?!)")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = (chr(256 + k) for k in range(256))
        self.byte_char = [chr(b) if b in printable else next(rest) for b in range(256)]
        self.merges = Merges.of(path, self.byte_char)
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {"\n": _END}

    def _piece(self, piece: bytes) -> bytes:
        return np.array([t.id for t in self.model.tokenize("".join([self.byte_char[b] for b in piece]))], "<u4").tobytes()

    def _learn_pieces(self, pieces: set[str]) -> None:
        """The ids of these lower-case pieces, into ``pieces``."""
        if len(self.pieces) >= CACHE_WORDS:
            self.pieces = {"\n": _END}
        new = sorted(pieces.difference(self.pieces), key=len)
        data = "\n".join(new).encode().split(b"\n")
        short = bisect.bisect_right(new, PIECE_CHARS, key=len) if self.merges else 0
        for at in range(0, short, MERGED_AT_ONCE):
            stop = min(at + MERGED_AT_ONCE, short)
            self.pieces.update(zip(new[at:stop], self.merges(data[at:stop]), strict=True))
        self.pieces.update(zip(new[short:], map(self._piece, data[short:]), strict=False))

    def _ids(self, distinct: list[bytes]) -> list[bytes]:
        """The ids of each word."""
        if len(self.words) >= CACHE_WORDS:
            self.older, self.words = self.words, {}
        words = self.words
        found = list(map(words.get, distinct))
        if None in found:
            missing = _without(distinct, found)
            late = list(map(self.older.get, missing))
            words.update(zip(missing, late, strict=True))
            self._learn(_without(missing, late))
            found = list(map(words.__getitem__, distinct))
        return found

    def _learn(self, missing: list[bytes]) -> None:
        """The ids of these words, into ``words``."""
        # No word holds a line feed, and a broken character before one does not take it along.
        text = b"\n".join(missing).decode("utf-8", "replace")
        odd = [m.start() for find in (_ODD, self.special) for m in find.finditer(text)]
        if odd:
            texts = text.split("\n")
            after = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
            whole = set(np.searchsorted(after, odd, "right").tolist())
            for k in whole:
                self.words[missing[k]] = np.array(self.whole.encode(texts[k], add_special_tokens=False).ids, "<u4").tobytes()
            missing = [w for k, w in enumerate(missing) if k not in whole]
            text = "\n".join([t for k, t in enumerate(texts) if k not in whole])
        if missing:
            pieces = _PIECE.findall(text.lower())
            self._learn_pieces(set(pieces))
            self.words.update(zip(missing, b"".join(map(self.pieces.__getitem__, pieces)).split(_END), strict=True))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (UTF-8 bytes) one after another, and where each text's begin (one more for the end)."""
        large = pa.types.is_large_binary(texts.type)
        parts = pc.ascii_split_whitespace(texts.view(pa.large_string() if large else pa.string()))
        coded = parts.flatten().dictionary_encode()
        distinct = coded.dictionary.view(pa.large_binary() if large else pa.binary()).to_numpy(zero_copy_only=False).tolist()
        found = self._ids(distinct)
        size = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        first = np.cumsum(size) - size
        word = coded.indices.to_numpy()
        stop = np.concatenate(([0], np.cumsum(size[word])))
        known, out = np.frombuffer(b"".join(found), "<u4"), np.empty(stop[-1], "<u4")
        for k in range(0, len(word), WORDS_AT_ONCE):
            some, (begin, end) = word[k : k + WORDS_AT_ONCE], stop[[k, min(k + WORDS_AT_ONCE, len(word))]]
            out[begin:end] = known[np.repeat(first[some] - stop[k : k + len(some)], size[some]) + np.arange(begin, end)]
        bounds = np.concatenate(([0], np.cumsum(pc.list_value_length(parts).to_numpy())))
        return out, stop[bounds]


_tokenizers: dict[str, WordTokenizer] = {}


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""

    def cut(batch):
        tokenizer = _tokenizers.get(tokenizer_path)
        if tokenizer is None:
            tokenizer = _tokenizers[tokenizer_path] = WordTokenizer(tokenizer_path)
        ids, piece, start, length, crc = [], [], [], [], []
        found, bounds = tokenizer(batch.column(1))
        bounds = bounds.tolist()
        for doc_id, first, stop in zip(batch.column(0).to_pylist(), bounds[:-1], bounds[1:], strict=True):
            data = found[first:stop].tobytes() + b"\0\0\0\0"
            for k, at in enumerate(range(0, len(data), 4 * capacity)):
                part = data[at : at + 4 * capacity]
                ids.append(doc_id)
                piece.append(k)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        return {
            "doc_id": pa.array(ids, pa.int64()), "piece": pa.array(piece, pa.int32()),
            "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
            "ids_crc32": pa.array(crc, pa.int64())
        }

    return arrow_map(text_bytes(docs), PIECES, cut, TEXT_BYTES)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, placed in the given order.

    ``count[h]`` is the number of open bins filled to h.  An item of size s goes where the sum of
    squared counts grows least: into a bin filled to h (the count moves from h to h + s; a bin that
    becomes full leaves the sum) or into a new one.  Ties go to the fullest bin.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offset, n = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    never = np.int64(1) << 60
    for k, s in enumerate(sizes.tolist()):
        if s < capacity:
            here, there = count[1 : capacity - s + 1], count[s + 1 : capacity + 1]
            cost = np.where(here > 0, there - here + 1, never)
            cost[-1] = -here[-1] if here[-1] else never  # the bin is full and leaves the sum
            cost = cost[::-1]
            best = int(cost.argmin())
            level = capacity - s - best
            if cost[best] <= count[s]:
                at = open_bins[level].pop()
                count[level] -= 1
            else:
                level, at, n = 0, n, n + 1
        else:
            level, at, n = 0, n, n + 1
        bins[k], offset[k] = at, level
        if level + s < capacity:
            open_bins[level + s].append(at)
            count[level + s] += 1
    return bins, offset


def pack(pieces: DataFrame, capacity: int, shard_rows: int = 8192) -> DataFrame:
    """Adds sequence_id and offset to the rows of ``pieces``, which should be a table: they are counted first."""
    shards = max(1, -(-pieces.count() // shard_rows))
    schema = PIECES + ", sequence_id long, offset long"

    def place(key, rows):
        rows = rows.drop_columns(["shard"]).sort_by(
            [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]
        )
        bins, offset = sum_of_squares(rows["length"].to_numpy(), capacity)
        rows = rows.append_column("sequence_id", pa.array(bins + (key[0].as_py() << 32)))
        return rows.append_column("offset", pa.array(offset))

    keyed = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "_row"), F.lit(shards))).drop("_row")
    return keyed.groupBy("shard").applyInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = token_pieces(docs, tokenizer_path, capacity)
    # A number of its own deals rows that agree in everything to all shards.
    return pack(table(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces"), capacity)
