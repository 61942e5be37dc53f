"""Dense per-document measurements, computed for many documents at once with numpy."""

from __future__ import annotations

from functools import cached_property

import numpy as np

from .common import U64, byte_prefix, flat, mix, span_hash, windows, words

LOWER, UPPER, DIGIT, SPACE, SYMBOL, BANG, STOP, PUNCT, LEAD, TAIL, PIPE = range(11)


def _classes() -> np.ndarray:
    kind = np.full(256, PUNCT, np.uint8)
    kind[97:123], kind[65:91], kind[48:58] = LOWER, UPPER, DIGIT
    kind[[32, 9, 10, 11, 12, 13]] = SPACE
    kind[[ord(c) for c in "#*$%&<>"]] = SYMBOL
    kind[ord("|")], kind[ord("!")] = PIPE, BANG
    kind[[ord(c) for c in ".,;:?"]] = STOP
    kind[128:192], kind[192:] = TAIL, LEAD
    return kind


_CLASS = _classes()


class TextStats:
    """Counts of the texts in a binary Arrow column; every array has a value per document unless said."""

    def __init__(self, column):
        self.data, self.at = flat(column)
        self.n = len(self.at) - 1
        self.n_bytes = np.diff(self.at)
        self.prefix = byte_prefix(self.data)
        self.start, self.stop, self.first = words(self.data, self.at)
        self.n_words = np.diff(self.first)

    @cached_property
    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    @cached_property
    def codes(self) -> np.ndarray:
        """A hash for each word."""
        return span_hash(self.prefix, self.start, self.stop)

    @cached_property
    def classes(self) -> np.ndarray:
        """Bytes of each class: a row per document."""
        doc = np.repeat(np.arange(self.n) * 16, self.n_bytes)
        return np.bincount(doc + _CLASS[self.data], minlength=16 * self.n).reshape(self.n, 16)[:, :11]

    @cached_property
    def n_chars(self) -> np.ndarray:
        return self.n_bytes - self.classes[:, TAIL]

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self.n_chars - self.classes[:, SPACE]

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.classes[:, SYMBOL] + self.classes[:, PIPE]

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per word."""
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[self.first[1:]] - total[self.first[:-1]]

    @cached_property
    def n_distinct(self) -> np.ndarray:
        key = mix(self.codes) ^ mix(self.doc_of_word.astype(U64) + U64(1))  # the same word of another document has another key
        if not len(key):
            return np.zeros(self.n, np.int64)
        order = np.argsort(key)
        new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
        return np.bincount(self.doc_of_word[order][new], minlength=self.n)

    @cached_property
    def repeated_words(self) -> np.ndarray:
        """Words in 8-word windows that the document has twice or more (a flag per word)."""
        hashes, begin = windows(self.codes, self.first, 8, 31)
        count = np.diff(begin)
        doc = np.repeat(np.arange(self.n), count)
        word = np.arange(len(hashes)) - begin[:-1].repeat(count) + self.first[:-1].repeat(count)
        key = hashes ^ mix(doc.astype(U64) + U64(1))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(self.start) + 9, np.int64)
        np.add.at(cover, word[twice], 1)
        np.add.at(cover, word[twice] + 8, -1)
        return np.cumsum(cover)[: len(self.start)] > 0

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each line split at newlines: start, stop, document; and the first line of each document (one more for the end)."""
        breaks = np.flatnonzero(self.data == 10)
        start = np.sort(np.concatenate((self.at[:-1], breaks + 1)), kind="stable")
        # A break at a text's last byte and the next text's start coincide; the break's empty line comes first.
        own = np.searchsorted(self.at, breaks, side="right") - 1
        first = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=self.n) + 1)))
        doc = np.repeat(np.arange(self.n), np.diff(first))
        last = np.zeros(len(start), bool)
        last[first[1:] - 1] = True
        stop = np.concatenate((start[1:] - 1, [0]))
        stop[last] = self.at[1:]
        return start, stop, doc, first

    @cached_property
    def line_words(self) -> np.ndarray:
        """Words of each line."""
        start, stop, _, _ = self.lines
        return np.searchsorted(self.start, stop) - np.searchsorted(self.start, start)

    @cached_property
    def repeated_lines(self) -> np.ndarray:
        """Lines with a word that equal an earlier line of the document (a flag per line)."""
        start, stop, doc, _ = self.lines
        key = span_hash(self.prefix, start, stop) ^ mix(doc.astype(U64) + U64(1))
        order = np.argsort(key, kind="stable")
        later = np.zeros(len(key), bool)
        later[order[1:]] = key[order][1:] == key[order][:-1]
        return later & (self.line_words > 0)

    @cached_property
    def n_lines(self) -> np.ndarray:
        return np.diff(self.lines[3])

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        return np.bincount(self.lines[2], weights=self.repeated_lines, minlength=self.n).astype(np.int64)

    def quality_features(self) -> np.ndarray:
        """A row of ratios for each document; all zero for an empty text."""
        c, chars, n = self.classes, np.maximum(self.n_chars, 1), np.maximum(self.n_words, 1)
        letters = np.maximum(c[:, LOWER] + c[:, UPPER] + c[:, LEAD], 1)
        length = self.stop - self.start
        cap = (self.data[self.start] >= 65) & (self.data[self.start] <= 90) if len(self.start) else np.zeros(0, bool)
        odd = np.isin(_CLASS[self.data[self.stop - 1]], (SYMBOL, BANG, PIPE)) if len(self.start) else cap
        columns = [c[:, k] / chars for k in (DIGIT, SPACE, SYMBOL, BANG, STOP, PUNCT, LEAD, PIPE)]
        columns += [c[:, UPPER] / letters, self.per_doc(cap) / n, self.per_doc(odd) / n, self.per_doc(length) / n / 10, self.per_doc(length <= 3) / n]
        columns += [
            self.n_distinct / n, self.per_doc(self.repeated_words) / n, self.n_dup_lines / self.n_lines,
            np.log1p(self.n_words) / 10, np.log1p(self.n_words / self.n_lines) / 5
        ]
        columns += [(self.n_words == 0).astype(float), (self.n_words < 20).astype(float)]
        return np.column_stack(columns).astype(np.float64)


QUALITY_NAMES = (
    "digits", "space", "symbols", "bangs", "stops", "punctuation", "accents", "pipes", "capitals", "capital_words",
    "odd_ends", "word_length", "short_words", "distinct", "repeated", "repeated_lines", "log_words", "log_line_words",
    "empty", "short"
)


