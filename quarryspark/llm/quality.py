"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text gives a row of statistics (sizes, character classes, repetition, punctuation);
logarithms and logits make them roughly normal. Per class the sums needed for mean and
covariance are added up over all labelled documents, one small row a class and entry, so
training covers every labelled row and moves almost nothing. A class covariance is shrunk
towards the pooled one (``to_pooled``) and both towards a multiple of the identity
(``to_identity``). A score is the logistic function of the difference of the classes'
Mahalanobis log-densities and log-priors, from Cholesky factors that are computed once.

Cases: null and empty texts get the statistics of an empty text and are scored; with no
labels, or one class only, every score is 0.5 or that class's; repeated rows score alike; a
document with several labels counts once for each; columns that clash with ``score`` or
``predicted`` are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryspark.llm.words import SPACE, grouped, word_hashes
from quarryspark.runtime import materialize

_KINDS = np.zeros((256, 8), "float32")
_KINDS[97:123, 0] = 1  # lower case
_KINDS[65:91, 1] = 1  # upper case
_KINDS[48:58, 2] = 1  # digits
_KINDS[128:192, 3] = 1  # continuation bytes: characters beyond ASCII
_KINDS[[46, 44, 59, 58, 63, 33], 4] = 1  # . , ; : ? !
_KINDS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:?!'\"-()"], 5] = 1  # other signs
_KINDS[10, 6] = 1  # lines
_KINDS[[46, 33, 63], 7] = 1  # sentence ends
N_STATISTICS = 16


def _logit(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of a share x / n, kept away from 0 and 1 by half a count."""
    return np.log((x + 0.5) / (np.maximum(n - x, 0) + 0.5))


def text_statistics(texts: list[bytes]) -> np.ndarray:
    """A row of N_STATISTICS transformed statistics a text."""
    out = np.zeros((len(texts), N_STATISTICS))
    for lo, hi in grouped(texts):
        part = texts[lo:hi]
        raw = np.frombuffer(b" ".join(part) + b" ", "uint8")
        at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in part])])
        kinds = np.stack([np.add.reduceat(_KINDS[:, k][raw], at[:-1], dtype="float64") for k in range(8)], axis=1)
        size = np.array([len(t) for t in part], "float64")
        solid = np.maximum(size - np.add.reduceat(SPACE[raw], at[:-1], dtype="float64") + 1, 1)
        hashes, where = word_hashes(part)
        n = np.diff(where).astype("float64")
        lower, upper, digits, beyond, marks, signs, lines, ends = kinds.T
        letters = lower + upper + beyond
        distinct, repeats, top = np.zeros(len(part)), np.zeros(len(part)), np.zeros(len(part))
        for k in range(len(part)):
            h = hashes[where[k] : where[k + 1]]
            if len(h):
                s = np.sort(h)
                edges = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
                distinct[k], top[k] = len(edges) - 1, np.diff(edges).max()
                repeats[k] = (h[1:] == h[:-1]).sum()
        out[lo:hi] = np.stack(
            [
                np.log1p(n), np.log1p(solid / np.maximum(n, 1)), _logit(upper, letters), _logit(digits, solid), _logit(beyond, letters), _logit(marks, solid), _logit(signs, solid),
                np.log1p(n / (lines + 1)), np.log1p(n / (ends + 1)), _logit(distinct, n), _logit(repeats, n), _logit(top, n),
                np.log1p(signs / np.maximum(n, 1)), np.sqrt(signs / solid), np.sqrt(upper / np.maximum(letters, 1)), np.sqrt(repeats / np.maximum(n, 1)),
            ],
            axis=1,
        )
    return out


@dataclass
class Gaussian:
    mean: np.ndarray
    factor: np.ndarray  # inverse of the Cholesky factor, lower triangular
    constant: float  # log-prior less half the log-determinant

    def density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.factor.T
        return self.constant - 0.5 * (z * z).sum(1)


@dataclass
class QualityModel:
    centre: np.ndarray
    scale: np.ndarray
    classes: list[Gaussian | None]  # of label 0 and 1
    temper: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        bad, good = self.classes
        if bad is None or good is None:
            return np.full(len(x), 0.5 if bad is good else float(good is not None))
        z = (x - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip((good.density(z) - bad.density(z)) * self.temper, -60, 60)))


def fit_quality(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], to_pooled: float = 0.1, to_identity: float = 0.02) -> QualityModel:
    """From per class (rows, sum of x, sum of x x')."""
    d = N_STATISTICS
    n = sum(s[0] for s in sums.values())
    if not n:
        return QualityModel(np.zeros(d), np.ones(d), [None, None])
    centre = sum(s[1] for s in sums.values()) / n
    scale = np.sqrt(np.maximum(np.diag(sum(s[2] for s in sums.values())) / n - centre**2, 1e-6))
    moments = {}
    for k, (m, sx, sxx) in sums.items():
        if m:
            mean = sx / m
            moments[k] = m, (mean - centre) / scale, (sxx / m - np.outer(mean, mean)) / np.outer(scale, scale)
    pooled = sum(m * c for m, _, c in moments.values()) / n
    classes: list[Gaussian | None] = [None, None]
    for k, (m, mean, own) in moments.items():
        c = (1 - to_pooled) * own + to_pooled * pooled
        c = (1 - to_identity) * c + to_identity * max(np.trace(c) / d, 1e-6) * np.eye(d)
        lower = np.linalg.cholesky(c)
        classes[k] = Gaussian(mean, np.linalg.inv(lower), float(np.log(m / n) - np.log(np.diag(lower)).sum()))
    return QualityModel(centre, scale, classes)


def with_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = text_statistics([(t or "").encode() for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_STATISTICS).cast(pa.list_(pa.float64()))], names=[id_col, "stats"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, stats array<double>")


def train_quality(stats: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality") -> QualityModel:
    """Fit on all rows of ``labels`` (id, 0 or 1) that have statistics."""
    labelled = stats.join(labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")), F.col(id_col) == F.col("_id")).select("label", "stats")
    d = N_STATISTICS

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = b.column(0).to_numpy(zero_copy_only=False)
            for k in (0, 1):
                z = x[y == k]
                total[k] += np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
        yield pa.RecordBatch.from_pydict({"label": np.repeat([0, 1], total.shape[1]).astype("int32"), "entry": np.tile(np.arange(total.shape[1], dtype="int32"), 2), "value": total.ravel()})

    rows = labelled.mapInArrow(summed, "label int, entry int, value double").groupBy("label", "entry").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros((2, 1 + d + d * d))
    total[rows.column("label").to_numpy(), rows.column("entry").to_numpy()] = rows.column("value").to_numpy()
    return fit_quality({k: (total[k, 0], total[k, 1 : 1 + d], total[k, 1 + d :].reshape(d, d)) for k in (0, 1)})


def score_quality(stats: DataFrame, model: QualityModel, *, id_col: str = "doc_id") -> DataFrame:
    """(id, score, predicted) of every row of statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype("int32"))], names=[id_col, "score", "predicted"])

    return stats.mapInArrow(run, f"`{id_col}` {stats.schema[id_col].dataType.simpleString()}, score double, predicted int")


def classify_quality(docs: DataFrame, labels: DataFrame, trainable: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Read the texts once, train on the labels whose id meets ``trainable``, score every document."""
    stats = materialize(with_statistics(docs, id_col=id_col, text_col=text_col))
    return score_quality(stats, train_quality(stats, labels.filter(trainable), id_col=id_col, label_col=label_col), id_col=id_col)
