"""Toxicity by gradient-boosted trees over dense features, isotonically calibrated (operator 7).

The lexicon is learned from the training rows: folded words that are much more
frequent in toxic documents.  Features are lexicon densities, hits near
second-person words, capitals, punctuation, and the rate of hits that only
folding look-alike characters reveals.  Histogram trees are boosted on the
logistic loss; pool-adjacent-violators on out-of-fold scores makes the
probabilities.

The fit takes at most ``SAMPLE`` labelled training rows; scoring covers all
documents in one pass without a shuffle.

Defined cases: as for the quality classifier; without training rows of both
kinds every score is the share of toxic rows (0.0 without labels).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, arrow_map, byte_prefix, flat, span_hash, text_bytes
from .quality import SAMPLE, features_of, held_out, labelled_sample, matrix
from .textstats import BANG, PIPE, STOP, SYMBOL, UPPER, TextStats

#: Second-person words of English, German, French and Spanish (fixed values).
SECOND_PERSON = (
    "you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te",
    "toi", "ton", "ta", "vous", "votre", "tus", "usted", "ustedes", "vosotros"
)
#: Look-alike characters and the letters they stand for (fixed values).
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
#: Bounds of the lexicon, all parameters of ``learn_lexicon`` (the README states their effect): most words, how much
#: oftener toxic training rows hold a word, and in how many and which share of them it must be.
LEXICON_WORDS, LEXICON_RATIO, LEXICON_ROWS, LEXICON_SHARE = 400, 4.0, 3, 0.005

_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)
_FOLDED = _PLAIN.copy()
for _from, _to in LOOKALIKES.items():
    _FOLDED[ord(_from)] = ord(_to)


def _tokens(data: np.ndarray, at: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every run of letters after folding."""
    mapped = fold[data]
    solid = mapped != 32
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before, after = np.concatenate(([False], solid)), np.concatenate((solid, [False]))
    start, stop = np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))
    codes = span_hash(byte_prefix(mapped), start, stop)
    return codes, np.searchsorted(at, start, side="right") - 1


def _without_stars(column):
    """The texts without characters that are put inside words to hide them."""
    data, at = flat(column)
    keep = ~np.isin(data, np.frombuffer(b"*.-_'", np.uint8))
    moved = np.concatenate(([0], np.cumsum(keep)))
    return data[keep], moved[at]


def word_hash(words) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    at = np.concatenate(([0], np.cumsum([len(w.encode()) for w in words]))).astype(np.int64)
    return span_hash(byte_prefix(data), at[:-1], at[1:])


def _member(codes: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_) or not len(codes):
        return np.zeros(len(codes), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, codes), len(sorted_) - 1)] == codes


NAMES = (
    "hits", "log_hits", "hidden", "hidden_rate", "distinct_hits", "near_you", "you", "capitals", "bangs", "stops",
    "symbols", "pipes", "log_words", "shouted_hits"
)


def dense_features(column, lexicon: np.ndarray) -> np.ndarray:
    stats = TextStats(column)
    data, at, n = stats.data, stats.at, stats.n
    you = np.sort(word_hash(SECOND_PERSON))
    count = lambda doc, flag: np.bincount(doc[flag], minlength=n)
    codes, doc = _tokens(data, at, _PLAIN)
    plain = _member(codes, lexicon)
    hits = count(doc, plain)
    folded_codes, folded_doc = _tokens(data, at, _FOLDED)
    bare, bare_at = _without_stars(column)
    bare_codes, bare_doc = _tokens(bare, bare_at, _FOLDED)
    revealed = np.maximum(count(folded_doc, _member(folded_codes, lexicon)), count(bare_doc, _member(bare_codes, lexicon)))
    hidden = np.maximum(revealed - hits, 0)
    pronoun = _member(codes, you)
    near = np.zeros(len(codes) + 7, np.int64)
    where = np.flatnonzero(pronoun)
    np.add.at(near, np.maximum(where - 3, 0), 1)
    np.add.at(near, where + 4, -1)
    close = plain & (np.cumsum(near)[: len(codes)] > 0)
    pair = np.unique(np.stack((doc[plain].astype(U64), codes[plain])), axis=1)
    kinds = np.bincount(pair[0].astype(np.int64), minlength=n) if plain.any() else np.zeros(n, np.int64)
    words, chars = np.maximum(np.bincount(doc, minlength=n), 1), np.maximum(stats.n_chars, 1)
    c = stats.classes
    capital = c[:, UPPER] / chars
    return np.column_stack(
        [
            hits / words * 100, np.log1p(hits), np.log1p(hidden), hidden / words * 100, np.log1p(kinds),
            np.log1p(count(doc, close)), count(doc, pronoun) / words, capital, c[:, BANG] / chars, c[:, STOP] / chars,
            c[:, SYMBOL] / chars, c[:, PIPE] / chars, np.log1p(stats.n_words), hits / words * 100 * capital
        ]
    ).astype(np.float64)


def learn_lexicon(
    sample: DataFrame, most: int = LEXICON_WORDS, ratio: float = LEXICON_RATIO, rows: int = LEXICON_ROWS,
    share: float = LEXICON_SHARE
) -> np.ndarray:
    """Sorted hashes of at most ``most`` words that toxic training rows hold much oftener; counted by document in Spark."""

    def per_document(batch):
        data, at = flat(batch.column(1))
        codes, doc = _tokens(data, at, _PLAIN)
        pair = np.unique(np.stack((doc.astype(U64), codes)), axis=1)
        label = batch.column(2).to_numpy()
        return {"code": pa.array(pair[1].view(np.int64)), "label": pa.array(label[pair[0].astype(np.int64)])}

    words = arrow_map(sample, "code long, label int", per_document).groupBy("code").agg(F.sum("label").alias("bad"), F.count("*").alias("all"))
    totals = sample.agg(F.sum("label"), F.count("*")).first()
    bad, every = totals[0] or 0, totals[1]
    if not bad or bad == every:
        return np.zeros(0, U64)
    share_bad, share_rest = F.col("bad") / bad, (F.col("all") - F.col("bad") + 0.5) / (every - bad)
    top = words.where((F.col("bad") >= rows) & (share_bad >= ratio * share_rest)).withColumn("gain", share_bad - share_rest)
    # Rarer words are chance.
    top = top.where(share_bad >= share).orderBy(F.desc("gain"), "code").limit(most).select("code").collect()
    return np.sort(np.array([r[0] for r in top], np.int64).view(U64))


class BoostedTrees:
    """Histogram gradient boosting of depth-limited trees on the logistic loss.

    ``least`` is the weight (sum of second derivatives) that both sides of a split must have.
    """

    def __init__(
        self, x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32,
        least: float = 2.0, ridge: float = 1.0
    ):
        self.edges = [np.unique(np.quantile(f, np.linspace(0, 1, bins + 1)[1:-1])) for f in x.T]
        self.base = float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
        self.rate, self.trees = rate, []
        b = self._bin(x)
        raw = np.full(len(x), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            tree: dict = {}
            self._grow(tree, 1, b, g, h, np.arange(len(x)), depth, bins, least, ridge)
            self.trees.append(tree)
            raw += rate * self._leaf(tree, b)

    def _bin(self, x):
        return np.column_stack(
            [np.searchsorted(e, f, side="right") for e, f in zip(self.edges, x.T, strict=True)]
        ).astype(np.int64) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def _grow(self, tree, node, b, g, h, rows, depth, bins, least, ridge):
        gs, hs = g[rows].sum(), h[rows].sum()
        tree[node] = (-gs / (hs + ridge), None, None)
        if depth == 0:
            return
        best = (1e-6, None, None)
        for f in range(b.shape[1]):
            at = b[rows, f]
            cg, ch = (np.cumsum(np.bincount(at, weights=v, minlength=bins))[:-1] for v in (g[rows], h[rows]))
            gain = cg**2 / (ch + ridge) + (gs - cg) ** 2 / (hs - ch + ridge) - gs**2 / (hs + ridge)
            gain[(ch < least) | (hs - ch < least)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, k)
        if best[1] is None:
            return
        tree[node] = (tree[node][0], best[1], best[2])
        low = b[rows, best[1]] <= best[2]
        self._grow(tree, 2 * node, b, g, h, rows[low], depth - 1, bins, least, ridge)
        self._grow(tree, 2 * node + 1, b, g, h, rows[~low], depth - 1, bins, least, ridge)

    @staticmethod
    def _leaf(tree, b):
        node, out = np.ones(len(b), np.int64), np.zeros(len(b))
        for k in sorted(tree):
            value, f, cut = tree[k]
            here = np.flatnonzero(node == k)
            if f is None:
                out[here] = value
            else:
                node[here] = 2 * k + (b[here, f] > cut)
        return out

    def __call__(self, x):
        b = self._bin(x)
        return self.base + self.rate * sum((self._leaf(t, b) for t in self.trees), np.zeros(len(x)))


class Isotonic:
    """Non-decreasing fit of labels to scores (pool adjacent violators), linear between blocks."""

    def __init__(self, score: np.ndarray, y: np.ndarray):
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []
        for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
            blocks.append([v, 1.0, s])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                a, w, t = blocks.pop()
                old = blocks[-1]
                blocks[-1] = [old[0] + a, old[1] + w, (old[2] * old[1] + t * w) / (old[1] + w)]
        self.at = np.array([b[2] for b in blocks])
        self.value = np.array([b[0] / b[1] for b in blocks])

    def __call__(self, score):
        return np.interp(score, self.at, self.value)


class ToxicityModel:
    def __init__(self, x: np.ndarray, y: np.ndarray, lexicon: np.ndarray):
        self.lexicon, self.share = lexicon, float(y.mean()) if len(y) else 0.0
        self.usable = 0 < self.share < 1
        if not self.usable:
            return
        folds = min(3, len(y))  # both labels are there, so at least two
        fold = np.arange(len(y)) % folds  # rows are in an order that the labels do not set
        held = np.zeros(len(y))
        for k in range(folds):
            held[fold == k] = BoostedTrees(x[fold != k], y[fold != k])(x[fold == k])
        self.trees, self.calibrate = BoostedTrees(x, y), Isotonic(held, y)

    def __call__(self, column) -> np.ndarray:
        if not self.usable:
            return np.full(len(column), self.share)
        return self.calibrate(self.trees(dense_features(column, self.lexicon)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> ToxicityModel:
    sample = labelled_sample(docs, labels, "toxic", bound)
    lexicon = learn_lexicon(sample)
    got = features_of(sample, NAMES, lambda column: dense_features(column, lexicon), "label")
    x, y = matrix(got, NAMES), got["label"].to_numpy()
    mixed = np.random.default_rng(7).permutation(len(y))
    return ToxicityModel(x[mixed], y[mixed].astype(float), lexicon)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = fit_toxicity(docs, labels)

    def score(batch):
        return {"doc_id": batch.column(0), "held_out": batch.column(2), "score": pa.array(model(batch.column(1)))}

    scored = arrow_map(text_bytes(docs, held_out(F.col("doc_id")).alias("held_out")), "doc_id long, held_out boolean, score double", score)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
