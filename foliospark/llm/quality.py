"""Quality classifier from positive and unlabelled documents (operator 10).

A logistic model over dense text features minimises the non-negative unbiased
risk  pi * E_p[l(+)] + max(0, E_u[l(-)] - pi * E_p[l(-)])  of trusted positives
(label 1) and unlabelled documents.  Of the logistic loss l(+) - l(-) is linear,
so the risk is convex and Newton rounds minimise it: each is one pass over the
features of all documents, which adds up gradient and Hessian where the rows
are.  Where the second part turns negative, the step goes against it.  The
class prior pi is estimated as the share of positives among the labelled
training rows.

The fit takes at most ``SAMPLE`` labelled training rows (those with the smallest
hash of doc_id) and every document as unlabelled; scoring covers all documents.

Defined cases: null text is the empty text; a null doc_id is never held out and
never trains as a positive; labels that are null or without a document do not
count; repeated rows are scored alike; without a trusted positive every score is
the prior (0.5 without labels); an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, forget, in_batches, table, text_bytes
from .textstats import QUALITY_NAMES, TextStats

#: Bound on the labelled rows that a fit takes.
SAMPLE = 12_000
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """The fold that no fit may see."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def chosen_labels(labels: DataFrame, column: str, bound: int = SAMPLE) -> DataFrame:
    """doc_id and label of at most ``bound`` training rows: those with the smallest hash of doc_id."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & ~held_out(F.col("doc_id")))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(bound)


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, bound: int = SAMPLE) -> DataFrame:
    """doc_id, text (binary) and label of the training rows."""
    return text_bytes(docs).join(F.broadcast(chosen_labels(labels, column, bound)), "doc_id")  # at most ``bound`` rows of two numbers


def features_of(sample: DataFrame, names: tuple[str, ...], measure, *more: str) -> pa.Table:
    """The sample's feature rows on the driver: at most ``bound`` rows of some twenty numbers."""
    schema = ", ".join([f"`{c}` double" for c in names] + [f"{c} int" for c in more])

    def rows(batch):
        x = measure(batch.column(batch.schema.get_field_index("text")))
        return {c: pa.array(x[:, i]) for i, c in enumerate(names)} | {c: batch.column(batch.schema.get_field_index(c)) for c in more}

    got = arrow_map(sample, schema, rows).toArrow()
    return got.sort_by([(c, "ascending") for c in got.column_names])  # the same order whatever task came first


def matrix(got: pa.Table, names: tuple[str, ...]) -> np.ndarray:
    return np.column_stack([got[c].to_numpy() for c in names]) if len(got) else np.zeros((0, len(names)))


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features, their squares and a constant."""
    z = np.clip((x - mean) / scale, -4, 4)
    return np.column_stack((z, z * z / 4, np.ones(len(z))))


def risk_sums(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums over rows of the loss as a negative, of its gradient and of its Hessian, one after another."""
    z = x @ w
    s = logistic(z)
    return np.concatenate(([np.logaddexp(0, z).sum()], x.T @ s, ((x * (s * (1 - s))[:, None]).T @ x).ravel()))


class PUModel:
    """A linear score of expanded features and its logistic probability.

    ``unlabelled(w)`` gives the ``risk_sums`` of all documents and ``n`` is their number.
    """

    def __init__(
        self, positive: np.ndarray, mean: np.ndarray, scale: np.ndarray, unlabelled, n: int, prior: float,
        rounds: int = 12, decay: float = 1e-3
    ):
        self.prior, self.mean, self.scale = prior, mean, scale
        self.usable = len(positive) > 0 and n > 0 and 0 < prior < 1
        if not self.usable:
            return
        p = expand(positive, mean, scale)
        d = p.shape[1]
        w = np.zeros(d)
        w[-1] = np.log(prior / (1 - prior))
        best = np.inf
        for _ in range(rounds):
            u, q = unlabelled(w) / n, risk_sums(p, w) / len(p)
            rest = u[0] - prior * q[0]
            risk = prior * np.logaddexp(0, -(p @ w)).mean() + max(0.0, rest) + decay / 2 * (w @ w)
            if risk < best:
                best, self.weights = risk, w
            down = u[1 : d + 1] - prior * q[1 : d + 1]  # gradient of the second part
            g = down + prior * (p.T @ (logistic(p @ w) - 1)) / len(p) + decay * w if rest >= 0 else decay * w - down
            step = np.linalg.solve(u[d + 1 :].reshape(d, d) + decay * np.eye(d), g)
            w = w - step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
            w = np.round(w, 9)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not self.usable:
            return np.full(len(x), self.prior)
        return logistic(expand(x, self.mean, self.scale) @ self.weights)


def measure(column) -> np.ndarray:
    return TextStats(column).quality_features()


def quality_features(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and the features of every document, as a table."""

    def rows(batch):
        x = measure(batch.column(1))
        return {"doc_id": batch.column(0), "held_out": batch.column(2)} | {c: pa.array(x[:, i]) for i, c in enumerate(QUALITY_NAMES)}

    schema = "doc_id long, held_out boolean, " + ", ".join(f"`{c}` double" for c in QUALITY_NAMES)
    return table(arrow_map(text_bytes(docs, held_out(F.col("doc_id")).alias("held_out")), schema, rows), "features")


def _rows_of(batch) -> np.ndarray:
    return matrix(pa.Table.from_batches([batch]), QUALITY_NAMES)


def _summed(features: DataFrame, sums) -> np.ndarray:
    """``sums(feature rows)`` added up over all of them; one value of each task's vector is a row of the shuffle."""

    def run(batches):
        total = None
        for batch in batches:
            part = sums(_rows_of(batch))
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"j": np.arange(len(total)), "v": total})

    got = in_batches(features.select(*[f"`{c}`" for c in QUALITY_NAMES]), "j long, v double", run)
    return got.groupBy("j").agg(F.sum("v").alias("v")).toArrow().sort_by("j")["v"].to_numpy()


def fit_features(features: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> PUModel:
    labelled = features.join(F.broadcast(chosen_labels(labels, "quality", bound)), "doc_id").toArrow()  # at most ``bound`` rows and their repeats
    labelled = labelled.sort_by([(c, "ascending") for c in ("doc_id", "label", *QUALITY_NAMES)])
    x, y = matrix(labelled, QUALITY_NAMES), labelled["label"].to_numpy()
    k = len(QUALITY_NAMES)
    moments = _summed(features, lambda rows: np.concatenate(([len(rows)], rows.sum(0), (rows**2).sum(0))))
    n = moments[0] if len(moments) else 0.0
    mean = moments[1 : k + 1] / n if n else np.zeros(k)
    scale = np.sqrt(np.maximum(moments[k + 1 :] / n - mean**2, 0)) + 1e-3 if n else np.ones(k)
    return PUModel(
        x[y == 1], mean, scale, lambda w: _summed(features, lambda rows: risk_sums(expand(rows, mean, scale), w)), n,
        float(y.mean()) if len(y) else 0.5
    )


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    features = quality_features(docs)
    model = fit_features(features, labels)

    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "held_out": batch.column(1), "score": model(_rows_of(batch))})

    return in_batches(
        features, "doc_id long, held_out boolean, score double", score
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that the classifier keeps, with their columns."""
    features = quality_features(docs)
    model = fit_features(features, labels)
    forget(features)
    at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            text = batch.column(at).cast(pa.large_binary()).fill_null(b"")
            good = np.concatenate([model(measure(text.slice(i, 64))) for i in range(0, len(text), 64)]) if len(text) else np.zeros(0)
            yield batch.filter(pa.array(good >= threshold))

    return in_batches(docs, docs.schema, keep)
