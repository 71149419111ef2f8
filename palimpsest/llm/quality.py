"""Quality scores by Bradley-Terry pairwise ranking.

Labels give preferences: a document of label 1 is preferred to one of label 0. A document's
strength is linear in its text features; the probability that one is preferred to another
is the logistic function of the difference of strengths, and the weights minimise the
logistic loss over pairs' feature differences. A quantile of the strengths of the labelled
documents is the threshold; score = logistic(strength - threshold), so 0.5 lies there.

Defined results: null and empty texts have all-zero raw features and are scored like any
other; without preferences (no labels, or a single one) all weights are 0, every score is
0.5 and nothing is rejected; rows without id are scored, never learnt from; other columns,
whatever their names, are not read. Ties in the threshold count as accepted.

Scale: the labelled rows are a bounded sample (``bound`` of each label, those with the
least hash of their id), of which only feature vectors reach the driver; every preferred
row meets a fixed number of others, drawn with a fixed seed. Scoring is one narrow pass
over whole texts, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, pick

FEATURES = [
    "log_words", "word_bytes", "symbol_share", "upper_share", "digit_share", "bang_share", "pipe_share", "line_share", "other_bytes",
    "distinct_words", "repeated_next", "distinct_lines", "symbols_any", "bangs_any", "pipes_any", "repeats_any", "letters",
]
_SYMBOL = np.frombuffer(b"*#$%&@^~+=<>{}[]\\_`", dtype=np.uint8)


def features(text: bytes | None) -> list[float]:
    """The feature vector of a UTF-8 text, from byte counts, words and lines."""
    if not text:
        return [0.0] * len(FEATURES)
    n = len(text)
    c = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    words = text.split()
    k = max(1, len(words))
    lines = text.split(b"\n")
    upper, lower, digits, high = int(c[65:91].sum()), int(c[97:123].sum()), int(c[48:58].sum()), int(c[128:].sum())
    symbols, bangs, pipes = int(c[_SYMBOL].sum()), int(c[33]), int(c[124])
    repeats = sum(map(eq, words, words[1:]))
    return [
        np.log1p(len(words)), min(12.0, n / k), min(1.0, symbols / k), upper / max(1, upper + lower), digits / n, min(1.0, bangs / k), min(1.0, pipes / k),
        min(1.0, len(lines) / k), high / n, len(set(words)) / k / (1 + len(words) ** 0.5 / 40), repeats / k, len(set(lines)) / len(lines),
        symbols / (symbols + 0.05 * k + 1), bangs / (bangs + 0.05 * k + 1), pipes / (pipes + 0.05 * k + 1), repeats / (repeats + 0.05 * k + 1),
        (upper + lower + high) / n,
    ]


@dataclass
class BradleyTerry:
    """Weights of standardised features and their squares, and the accepting threshold."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0

    def rows(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([z, z * z], axis=1)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.rows(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.threshold, -500, 500)))


def fit_pairs(x: np.ndarray, y: np.ndarray, meets: int = 24, ridge: float = 1e-3, quantile: float | None = None, seed: int = 7) -> BradleyTerry:
    """Learn from feature rows and labels; ``quantile`` of the strengths is the threshold.

    Without a given quantile, the one that parts the labelled rows with the fewest errors
    is taken.
    """
    k = len(FEATURES)
    if len(x) == 0:
        x = np.zeros((0, k))
    model = BradleyTerry(x.mean(axis=0) if len(x) else np.zeros(k), np.maximum(x.std(axis=0) if len(x) else np.ones(k), 1e-6), np.zeros(2 * k))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return model
    rng = np.random.Generator(np.random.PCG64(seed))
    rows = model.rows(x)
    # each row of either label meets ``meets`` of the other
    a = np.concatenate([np.repeat(good, meets), rng.choice(good, len(bad) * meets)])
    b = np.concatenate([rng.choice(bad, len(good) * meets), np.repeat(bad, meets)])
    w = np.zeros(2 * k)
    for _ in range(25):  # Newton steps on the logistic loss of the differences
        grad, hess = ridge * len(a) * w, ridge * len(a) * np.eye(2 * k)
        for at in range(0, len(a), 50_000):
            d = rows[a[at : at + 50_000]] - rows[b[at : at + 50_000]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            grad = grad - d.T @ p
            hess += (d * (p * (1 - p))[:, None]).T @ d
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    s = rows @ w
    order = np.argsort(s, kind="stable")
    if quantile is None:
        below = np.concatenate([[0], np.cumsum(y[order] == 1)])  # preferred ones rejected
        above = len(bad) - np.concatenate([[0], np.cumsum(y[order] == 0)])  # others accepted
        cut = int(np.argmin(below + above))
        quantile = cut / len(s)
    at = min(max(int(round(quantile * len(s))), 1), len(s) - 1)
    model.threshold = float((s[order[at - 1]] + s[order[at]]) / 2)
    return model


def fit(documents: DataFrame, labels: DataFrame, doc_col: str = "doc_id", text_col: str = "text", label_doc_col: str = "doc_id", label_col: str = "quality", bound: int = 10_000, **more) -> BradleyTerry:
    """Learn from at most ``bound`` labelled rows of each label, whole texts."""
    marks = pick(labels, [(label_doc_col, "doc_id"), (label_col, "label")]).dropna().filter("label in (0, 1)").distinct()
    marks = bounded_sample(marks, "doc_id", "label", bound).select("doc_id", "label")
    docs = pick(documents, [(doc_col, "doc_id"), (text_col, "text")])
    rows = docs.join(F.broadcast(marks), "doc_id").select("doc_id", F.col("label").cast("int"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    found = sorted((r["doc_id"], r["label"], tuple(r["x"])) for r in rows.mapInArrow(run, "doc_id long, label int, x array<double>").collect())
    x = np.array([r[2] for r in found], dtype=np.float64).reshape(-1, len(FEATURES))
    return fit_pairs(x, np.array([r[1] for r in found], dtype=np.int64), **more)


def score_quality(documents: DataFrame, model: BradleyTerry, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in b.column(1).cast(pa.binary()).to_pylist()], dtype=np.float64).reshape(-1, len(FEATURES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return pick(documents, [(doc_col, "doc_id"), (text_col, "text")]).mapInArrow(run, "doc_id long, score double, predicted int")


def accepted(documents: DataFrame, model: BradleyTerry, text_col: str = "text") -> DataFrame:
    """The documents, all columns, whose score reaches the threshold."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([features(t.encode("utf-8") if t is not None else None) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))
        return pd.Series(model.score(x))

    return documents.filter(score(F.col(f"`{text_col}`")) >= 0.5)
