"""Quality rules with line labels from a linear-chain conditional random field (operator 5).

Base counts come from whole texts.  The CRF labels each line content or
boilerplate: emissions are linear in line features, Viterbi decoding finds the
best labelling, and the share of words in content lines decides retention.

The CRF is fitted by maximum conditional likelihood (forward-backward, L2) on
at most ``SAMPLE`` labelled training rows: lines of good documents stand for
content, lines of bad ones for boilerplate; sequences are read in windows of
``SEQUENCE`` lines in training only.

Defined cases: null text has no words; a document without words fails the
base; without labels of both kinds the CRF keeps what passes the base; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, text_bytes
from .quality import labelled_sample
from .textstats import _CLASS, BANG, DIGIT, LOWER, PIPE, PUNCT, STOP, SYMBOL, UPPER, TextStats

SAMPLE, SEQUENCE = 4_000, 64
N_FEATURES = 13


def line_features(stats: TextStats) -> np.ndarray:
    """A row for each line; the last column is 1."""
    start, stop, doc, first = stats.lines
    n = len(start)
    whole = np.diff(np.append(start, len(stats.data)))
    last = first[1:] - 1
    whole[last] = stats.at[1:] - start[last]
    counts = np.bincount(np.repeat(np.arange(n) * 16, whole) + _CLASS[stats.data], minlength=16 * n).reshape(n, 16)
    chars, letters = np.maximum(stop - start, 1), np.maximum(counts[:, LOWER] + counts[:, UPPER], 1)
    count = np.maximum(stats.line_words, 1)
    at = np.searchsorted(stats.start, start)
    total = np.concatenate(([0], np.cumsum(stats.repeated_words)))
    repeated = total[at + stats.line_words] - total[at]
    share = [counts[:, k] / chars for k in (SYMBOL, PIPE, BANG, DIGIT, STOP, PUNCT)]
    return np.column_stack(
        [
            *share, counts[:, UPPER] / letters, repeated / count, stats.repeated_lines, np.log1p(stats.line_words) / 4,
            (stop - start) / count / 10, stats.line_words == 0, np.ones(n)
        ]
    ).astype(np.float64)


class LineCRF:
    """Labels 0 boilerplate, 1 content; ``weights`` score label 1 against 0, ``move[i, j]`` a step from i to j."""

    def __init__(self, weights: np.ndarray, move: np.ndarray):
        self.weights, self.move = weights, move

    @classmethod
    def fit(cls, x: np.ndarray, mask: np.ndarray, y: np.ndarray, steps: int = 80, rate: float = 0.1, decay: float = 1e-3) -> LineCRF:
        """x: sequences x lines x features; mask: which lines are there; y: each sequence's label."""
        weights, move = np.zeros(x.shape[2]), np.zeros((2, 2))
        m, v = np.zeros(x.shape[2] + 4), np.zeros(x.shape[2] + 4)
        lines, pairs = mask.sum(), np.maximum((mask[:, 1:] & mask[:, :-1]).sum(), 1)
        gold_pairs = (mask[:, 1:] & mask[:, :-1]).sum(1)
        for t in range(1, steps + 1):
            emit = np.stack([np.zeros(mask.shape), x @ weights], axis=2)
            emit[~mask] = 0
            alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
            alpha[:, 0] = emit[:, 0]
            for k in range(1, x.shape[1]):
                step = np.logaddexp(alpha[:, k - 1, :1] + move[0], alpha[:, k - 1, 1:] + move[1]) + emit[:, k]
                alpha[:, k] = np.where(mask[:, k, None], step, alpha[:, k - 1])
            for k in range(x.shape[1] - 2, -1, -1):
                after = emit[:, k + 1] + beta[:, k + 1]
                step = np.logaddexp(move[:, 0] + after[:, :1], move[:, 1] + after[:, 1:])
                beta[:, k] = np.where(mask[:, k + 1, None], step, beta[:, k + 1])
            whole = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
            p = np.exp(alpha[:, :, 1] + beta[:, :, 1] - whole[:, None]) * mask
            grad = ((p - y[:, None] * mask)[:, :, None] * x).sum((0, 1)) / lines
            two = mask[:, 1:] & mask[:, :-1]
            g_move = np.zeros((2, 2))
            for i in (0, 1):
                for j in (0, 1):
                    joint = np.exp(alpha[:, :-1, i] + move[i, j] + emit[:, 1:, j] + beta[:, 1:, j] - whole[:, None])
                    g_move[i, j] = (joint * two).sum() - (gold_pairs[y == i].sum() if i == j else 0)
            g = np.concatenate((grad, g_move.ravel() / pairs)) + decay * np.concatenate((weights, 10 * move.ravel()))
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            delta = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            weights, move = weights - delta[:-4], move - delta[-4:].reshape(2, 2)
        return cls(weights, move)

    def viterbi(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best label of every line; sequences start at ``first`` (one more for the end), all advance together."""
        score, size = x @ self.weights, np.diff(first)
        order = np.argsort(-size, kind="stable")
        begin, size = first[:-1][order], size[order]
        best = np.zeros((len(begin), 2))
        back = np.zeros((len(score), 2), np.int8)
        label = np.zeros(len(score), np.int8)
        for t in range(int(size.max(initial=0))):
            n = int(np.searchsorted(-size, -t, side="left"))  # sequences longer than t
            at = begin[:n] + t
            if t:
                for j in (0, 1):
                    from0, from1 = best[:n, 0] + self.move[0, j], best[:n, 1] + self.move[1, j]
                    back[at, j] = from1 > from0
                    score_j = np.maximum(from0, from1)
                    if j == 0:
                        kept = score_j
                best[:n, 0], best[:n, 1] = kept, score_j
            best[:n, 1] += score[at]
        if not len(begin):
            return label
        label[begin + size - 1] = best[:, 1] > best[:, 0]
        for t in range(int(size.max()) - 1, 0, -1):
            n = int(np.searchsorted(-size, -t, side="left"))
            at = begin[:n] + t
            label[at - 1] = back[at, label[at]]
        return label


def fit_lines(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> LineCRF | None:
    """The CRF from at most ``bound`` labelled training rows; None without both labels."""

    def rows(batch):
        stats = TextStats(batch.column(1))
        x, first = line_features(stats), stats.lines[3]
        parts = [(d, x[a : min(a + SEQUENCE, first[d + 1])]) for d in range(stats.n) for a in range(first[d], first[d + 1], SEQUENCE)]
        label = batch.column(2).to_numpy()
        return {
            "label": pa.array([int(label[d]) for d, _ in parts], pa.int32()),
            "x": pa.array([p.astype("<f8").tobytes() for _, p in parts], pa.binary())
        }

    got = arrow_map(
        labelled_sample(docs, labels, "quality", bound), "label int, x binary", rows
    ).toArrow().sort_by([("label", "ascending"), ("x", "ascending")])
    y = got["label"].to_numpy()
    if not 0 < y.sum() < len(y):
        return None
    parts = [np.frombuffer(b, "<f8").reshape(-1, N_FEATURES) for b in got["x"].to_pylist()]
    x, mask = np.zeros((len(parts), max(map(len, parts)), N_FEATURES)), np.zeros((len(parts), max(map(len, parts))), bool)
    for k, p in enumerate(parts):
        x[k, : len(p)], mask[k, : len(p)] = p, True
    return LineCRF.fit(x, mask, y)


def quality_rules(docs: DataFrame, labels: DataFrame, share: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share."""
    crf = fit_lines(docs, labels)

    def judge(batch):
        stats = TextStats(batch.column(1))
        repeat = stats.per_doc(stats.repeated_words)
        failed = (stats.n_words < 20) | (100 * repeat > 30 * stats.n_words)
        content = np.ones(stats.n)
        if crf is not None:
            label = crf.viterbi(line_features(stats), stats.lines[3])
            content = np.bincount(stats.lines[2], weights=label * stats.line_words, minlength=stats.n) / np.maximum(stats.n_words, 1)
        long = lambda a: pa.array(a.astype(np.int64))
        return {
            "doc_id": batch.column(0), "n_words": long(stats.n_words), "word_chars": long(stats.word_chars),
            "n_symbols": long(stats.n_symbols), "n_dup_lines": long(stats.n_dup_lines), "n_repeat_words": long(repeat),
            "base_failed": pa.array(failed), "kept": pa.array(~failed & (content >= share)),
            "content_share": pa.array(content)
        }

    return arrow_map(
        text_bytes(docs),
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double",
        judge
    )
