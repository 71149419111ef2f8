"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine.

Terms are words and beginnings of words (3 and 5 letters), all that occur in any example.
A term weighs (1 + log tf) * idf * relevance; vectors have length 1. The relevance is the
square of r / (r + 15), r being the log-likelihood ratio of the term's counts in examples
of either label, and ``floor`` at least: with plain idf the many words of a text drown the
few that make it toxic (the README has the figures), while no term drops out of the space.

The examples lie in a block-max inverted index: they are sorted so that alike ones stand
together, and cut into blocks; for each term and block the index holds the largest weight
and the postings, those of frequent terms as rows of a matrix. A batch of queries bounds
every block from the maxima, opens each query's blocks from the highest bound down and
leaves those whose bound lies below its k-th cosine: the k nearest are exact. They vote with
cosine ** ``sharpness``; leave-one-out votes of the examples themselves calibrate the vote
to a probability (monotone logistic). Evidence is the nearest examples' ids, cosines and
labels.

Defined results: texts that share no term with any example, null and empty ones included,
get the smoothed share of label 1; without examples every score is 0; with examples of one
label only, every score is their smoothed share. Ties in cosine go to the earlier example.
Rows without id are scored, never learnt from; an id that stands on several rows is learnt
from one of its texts, the least by hash; other columns, whatever their names, are not read.
A text of any length is scored whole; its words take some 60 bytes each while it is.

Scale: the examples are a bounded sample (``bound`` rows of each label, those with the
least hash of their id), of which term counts come to the driver; the index has a size
bound and is broadcast. Scoring is one narrow pass over all rows and whole texts, without
a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, bounded_sample, pick

_WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 5)
SCORES = "doc_id long, score double, predicted int, neighbours array<struct<doc_id:long,cosine:double,label:int>>"
#: Sparse rows: where each row's entries start, their terms and their weights.
Rows = tuple[np.ndarray, np.ndarray, np.ndarray]


def terms_of(word: str) -> list[str]:
    """A word, and its beginnings."""
    return ["=" + word, *["^" + word[:k] for k in PREFIXES if len(word) > k]]


def terms(text: str | None) -> Counter:
    """Term counts of a text."""
    out: Counter = Counter()
    for w, n in Counter(_WORD.findall((text or "").lower())).items():
        for t in terms_of(w):
            out[t] += n
    return out


def _log_ratio(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
    """Log-likelihood ratio of terms in a of n and b of m texts."""
    out = np.zeros(len(a))
    if n and m:
        p = (a + b) / (n + m)
        for seen, size in ((a, n), (b, m)):
            for k, q in ((seen, p), (size - seen, 1 - p)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    out += np.where((k > 0) & (q > 0), 2 * k * np.log(k / (size * q)), 0.0)
    return np.maximum(out, 0.0)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges given by start and size: which range each place is of, and the places."""
    which = np.repeat(np.arange(len(starts)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)


class BlockMaxIndex:
    """Postings of unit vectors in blocks of examples, with the largest weight of each term and block.

    Terms in at least ``frequent`` of the examples have a row of a matrix in place of a list.
    """

    def __init__(self, rows: Rows, n_terms: int, block: int = 128, frequent: float = 0.05) -> None:
        starts, term, weight = rows
        self.n, self.block, self.n_blocks = len(starts) - 1, block, -(-(len(starts) - 1) // block)
        who = np.repeat(np.arange(self.n), np.diff(starts))
        order = np.lexsort((who, term))
        self.term, self.who, self.weight = term[order].astype(np.int32), who[order].astype(np.int32), weight[order]
        df = np.bincount(self.term, minlength=n_terms)
        often = np.flatnonzero(df >= max(4, frequent * self.n))
        self.row = np.full(n_terms, -1, np.int32)  # of a frequent term
        self.row[often] = np.arange(len(often))
        self.n_often = len(often)
        self._matrix: np.ndarray | None = None
        # a run of postings of one term in one block
        cell = self.term.astype(np.int64) * max(1, self.n_blocks) + self.who // block
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        self.run_start, self.run_size = first, np.diff(np.append(first, len(cell)))
        self.run_block = self.who[first] // block
        self.run_most = np.maximum.reduceat(self.weight, first) if len(first) else np.empty(0)
        self.runs = np.searchsorted(self.term[first], np.arange(n_terms + 1))  # each term's runs

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_matrix": None}  # built again from the postings

    def _dense(self) -> tuple[np.ndarray, np.ndarray]:
        if self._matrix is None:
            mine = self.row[self.term] >= 0
            self._matrix = np.zeros((self.n_often, self.n))
            self._matrix[self.row[self.term[mine]], self.who[mine]] = self.weight[mine]
            pad = np.zeros((self.n_often, self.n_blocks * self.block))
            pad[:, : self.n] = self._matrix
            self._most = pad.reshape(self.n_often, self.n_blocks, self.block).max(axis=2)
        return self._matrix, self._most

    def nearest(self, queries: Rows, k: int, but: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of each query's k nearest, by cosine and then by number; -1 and 0 where
        fewer have any. ``but`` is left out, one example a query."""
        starts, term, weight = queries
        q = len(starts) - 1
        out, cosines = np.full((q, k), -1), np.zeros((q, k))
        if not q or not self.n:
            return out, cosines
        matrix, most = self._dense()
        row = np.repeat(np.arange(q), np.diff(starts))
        often = self.row[term] >= 0
        dense = np.zeros((q, self.n_often))
        dense[row[often], self.row[term[often]]] = weight[often]
        row, term, weight = row[~often], term[~often], weight[~often]
        which, run = _spread(self.runs[term], self.runs[term + 1] - self.runs[term])
        row, weight = row[which], weight[which]
        cell = row * self.n_blocks + self.run_block[run]
        bound = dense @ most + np.bincount(cell, weight * self.run_most[run], q * self.n_blocks).reshape(q, -1)
        sums, opened = np.zeros((q, self.n)), np.zeros((q, self.n_blocks), bool)
        rank = np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1)

        def open_(wanted: np.ndarray) -> None:
            wanted &= ~opened & (bound > 0)
            for b in np.flatnonzero(wanted.any(axis=0)).tolist():
                mine, cols = np.flatnonzero(wanted[:, b]), slice(b * self.block, (b + 1) * self.block)
                sums[mine, cols] += dense[mine] @ matrix[:, cols]
            some = wanted[row, self.run_block[run]]
            posting, at = _spread(self.run_start[run[some]], self.run_size[run[some]])
            cells = row[some][posting] * self.n + self.who[at]
            sums.ravel()[:] += np.bincount(cells, weight[some][posting] * self.weight[at], q * self.n)
            opened[wanted] = True
            if but is not None:
                sums[np.arange(q), but] = 0.0

        done, step = 0, 2
        while done < self.n_blocks:
            # a bound that equals the k-th cosine is opened too: an earlier example wins a tie
            kth = np.partition(sums, self.n - k, axis=1)[:, self.n - k] if done and self.n >= k else np.zeros(q)
            wanted = (rank < done + step) & (bound >= kth[:, None] - 1e-9)
            open_(wanted)
            done, step = done + step, step * 4
        sums = np.round(sums, 12)
        kth = np.partition(sums, self.n - k, axis=1)[:, self.n - k] if self.n >= k else np.zeros(q)
        for i in range(q):
            who = np.flatnonzero((sums[i] >= kth[i]) & (sums[i] > 0))
            who = who[np.lexsort((who, -sums[i, who]))[:k]]
            out[i, : len(who)], cosines[i, : len(who)] = who, sums[i, who]
        return out, cosines


class NearestLabels:
    """Examples, their terms and index, and the calibrated vote.

    ``examples``: (id, term counts, label). ``counts``: how many rows of label 0 and 1 the
    examples stand for; votes are weighted so that a sample with other shares gives the same
    probabilities.
    """

    def __init__(self, examples: list[tuple[int, dict[str, int], int]], counts: tuple[int, int] | None = None, k: int = 31, sharpness: float = 4.0, floor: float = 0.02) -> None:
        self.k, self.sharpness = k, sharpness
        labels = np.array([label for _, _, label in examples], np.int64)
        pos, neg = int(labels.sum()), int(len(labels) - labels.sum())
        all_neg, all_pos = counts or (neg, pos)
        self.worth = np.array([all_neg / max(1, neg), all_pos / max(1, pos)])
        self.worth /= max(self.worth.max(), 1e-9)
        self.share = (all_pos + 0.5) / (all_pos + all_neg + 1) if len(labels) else 0.0
        self.terms = sorted(set().union(*[t for _, t, _ in examples])) if examples else []
        self.vocabulary = {t: i for i, t in enumerate(self.terms)}
        found = [np.array([self.vocabulary[t] for t in x], np.int64) for _, x, _ in examples]
        seen = [np.bincount(np.concatenate([np.empty(0, np.int64), *[f for f, y in zip(found, labels, strict=True) if y == label]]), minlength=len(self.terms)) for label in (0, 1)]
        ratio = _log_ratio(seen[1], pos, seen[0], neg)
        self.factor = np.log(1 + len(labels) / (1 + seen[0] + seen[1])) * np.maximum(floor, (ratio / (ratio + 15)) ** 2)
        rows = [(f, np.fromiter(x.values(), np.float64, len(x))) for f, (_, x, _) in zip(found, examples, strict=True)]
        strongest = [int(f[np.argmax((1 + np.log(n)) * self.factor[f])]) if len(f) else -1 for f, n in rows]
        order = sorted((i for i in range(len(rows)) if strongest[i] >= 0), key=lambda i: (labels[i], strongest[i], examples[i][0], i))
        self.ids = np.array([examples[i][0] for i in order], np.int64)
        self.labels = labels[order]
        own = self.unit(np.cumsum([0, *[len(rows[i][0]) for i in order]]), *[np.concatenate([np.empty(0), *[rows[i][j] for i in order]]) for j in (0, 1)])
        self.index = BlockMaxIndex(own, len(self.terms))
        self.slope, self.shift = 1.0, 0.0
        if pos and neg and len(order):
            votes = [self.vote(self._part(own, at, at + 200), np.arange(at, min(at + 200, len(order))))[0] for at in range(0, len(order), 200)]
            self._calibrate(np.concatenate(votes))
        self.forget()

    @staticmethod
    def _part(rows: Rows, lo: int, hi: int) -> Rows:
        starts, term, weight = rows
        some = starts[lo : hi + 1]
        return some - some[0], term[some[0] : some[-1]], weight[some[0] : some[-1]]

    def forget(self) -> None:
        """Empty the memory of words."""
        self.number: dict[str, int] = {}
        self.of_word = np.full((1024, 1 + len(PREFIXES)), -1, np.int64)

    def unit(self, starts: np.ndarray, term: np.ndarray, counts: np.ndarray) -> Rows:
        """Rows of term counts as vectors of length 1."""
        term = term.astype(np.int64)
        weight = (1 + np.log(counts)) * self.factor[term]
        which = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        size = np.sqrt(np.bincount(which, weight * weight, len(starts) - 1))
        return starts, term, weight / np.maximum(size[which], 1e-300)

    def _learn(self, words: list[str]) -> None:
        n = len(self.number)
        while n + len(words) > len(self.of_word):
            self.of_word = np.concatenate([self.of_word, np.full_like(self.of_word, -1)])
        for at, word in enumerate(words, n):
            self.number[word] = at
            for j, t in enumerate(terms_of(word)):
                self.of_word[at, j] = self.vocabulary.get(t, -1)

    def vectors(self, texts: list[str | None]) -> Rows:
        """The texts' unit vectors over the terms of the examples; empty without any term."""
        if len(self.number) > 400_000:
            self.forget()
        words = [_WORD.findall((t or "").lower()) for t in texts]
        self._learn(list(set().union(*words).difference(self.number)))
        flat = np.fromiter(map(self.number.__getitem__, chain.from_iterable(words)), np.int64)
        which = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        found = self.of_word[flat]
        keep = found >= 0
        keys, counts = np.unique((which[:, None] * max(1, len(self.terms)) + found)[keep], return_counts=True)
        doc, term = np.divmod(keys, max(1, len(self.terms)))
        return self.unit(np.searchsorted(doc, np.arange(len(texts) + 1)), term, counts)

    def vote(self, rows: Rows, but: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distance-weighted share of label 1 among each row's nearest, and who they are."""
        who, cos = self.index.nearest(rows, self.k, but)
        label = np.where(who >= 0, self.labels[who], 0)
        w = np.where(who >= 0, cos**self.sharpness * self.worth[label], 0.0)
        prior = 0.1 * self.worth[self.worth > 0].min()
        return (np.sum(w * label, axis=1) + prior * self.share) / (w.sum(axis=1) + prior), who, cos

    def _calibrate(self, votes: np.ndarray) -> None:
        """A logistic map of the votes' log-odds, fitted by Newton steps on weighted examples."""
        votes = np.clip(votes, 1e-4, 1 - 1e-4)
        a = np.stack([np.log(votes / (1 - votes)), np.ones_like(votes)], axis=1)
        y, worth = self.labels * 0.998 + 0.001, self.worth[self.labels]
        start, ridge = np.array([1.0, 0.0]), np.array([1.0, 0.1])
        w = start.copy()
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            hessian = (a * (worth * (p * (1 - p) + 1e-9))[:, None]).T @ a + np.diag(ridge)
            w = w - np.linalg.solve(hessian, a.T @ (worth * (p - y)) + ridge * (w - start))
        if w[0] > 0:
            self.slope, self.shift = float(w[0]), float(w[1])

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The probability of label 1 of each text, and its nearest examples (numbers, cosines)."""
        if not len(self.ids):
            return np.full(len(texts), self.share), np.full((len(texts), self.k), -1), np.zeros((len(texts), self.k))
        rows = self.vectors(texts)
        vote, who, cos = self.vote(rows)
        vote = np.clip(vote, 1e-4, 1 - 1e-4)
        p = 1 / (1 + np.exp(-(self.slope * np.log(vote / (1 - vote)) + self.shift)))
        told = self.worth.min() > 0  # by examples of either label
        return np.where((np.diff(rows[0]) > 0) & told, p, self.share), who, cos


def fit(documents: DataFrame, labels: DataFrame, doc_col: str = "doc_id", text_col: str = "text", label_doc_col: str = "doc_id", label_col: str = "toxic", bound: int = 1000, **more) -> NearestLabels:
    """Examples from at most ``bound`` labelled rows of each label, whole texts."""
    marks = pick(labels, [(label_doc_col, "doc_id"), (label_col, "label")]).dropna().filter("label in (0, 1)").distinct()
    sizes = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    marks = bounded_sample(marks, "doc_id", "label", bound).select("doc_id", "label")
    docs = pick(documents, [(doc_col, "doc_id"), (text_col, "text")])
    rows = docs.join(F.broadcast(marks), "doc_id").groupBy("doc_id", F.col("label").cast("int"))  # at most 2 * bound marks
    rows = rows.agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [terms(t) for t in b.column(2).to_pylist()]
            columns = [pa.array([list(x) for x in found], pa.list_(pa.string())), pa.array([list(x.values()) for x in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["doc_id", "label", "terms", "counts"])

    # of a bounded number of texts, the term counts come to the driver
    found = rows.mapInArrow(run, "doc_id long, label int, terms array<string>, counts array<long>").collect()
    examples = sorted(((r["doc_id"], r["label"], r) for r in found), key=lambda x: x[:2])
    examples = [(i, dict(zip(r["terms"], r["counts"], strict=True)), label) for i, label, r in examples]
    return NearestLabels(examples, (sizes.get(0, 0), sizes.get(1, 0)), **more)


def score_toxicity(documents: DataFrame, model: NearestLabels, doc_col: str = "doc_id", text_col: str = "text", evidence: int = 3) -> DataFrame:
    """doc_id, score, predicted and the nearest examples of every document."""
    model.forget()
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches_of(batches, rows=256, size=1_500_000):
            scores, who, cos = m.score(b.column(1).to_pylist())
            who, cos = who[:, :evidence], cos[:, :evidence]
            has = who >= 0
            some = who[has]
            flat = pa.StructArray.from_arrays([pa.array(m.ids[some]), pa.array(cos[has]), pa.array(m.labels[some].astype(np.int32))], fields=list(kind.value_type))
            near = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has.sum(axis=1))]).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), near], names=["doc_id", "score", "predicted", "neighbours"])

    return pick(documents, [(doc_col, "doc_id"), (text_col, "text")]).mapInArrow(run, SCORES)
