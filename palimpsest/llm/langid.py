"""Language identification by cross-parsing.

For each language a suffix automaton of labelled text gives, from any place of a word, the
longest match with that text; a match is a phrase, and the next one starts behind it (a
letter that the text lacks is a phrase of its own). Words are parsed with a space on either
side, one by one, so a word's phrases are counted once and remembered. The language whose
parse of the document takes the fewest phrases per letter wins; equal counts are told apart
by how rarely the phrases occur in the language's text (sum of -log of their share), then
by name. The score is the winner's share in a softmax over the normalised phrase counts.

Defined results: ``und`` with score 0 for null texts and texts without a letter, and for
all texts if nothing could be learnt; rows without id are predicted, never learnt from;
repeated rows are predicted alike; other columns, whatever their names, are not read.

Letters are those of Unicode's letter classes: ½, ² and Ⅷ are none. An id that stands on
several rows is learnt from one of its texts, the least by hash. A text of any length is
parsed whole; its words take some 60 bytes each while it is.

Scale: the text learnt from is bounded (``chars`` characters a language, of at most ``docs``
documents with the least hash of their id, the last of them learnt up to there), so the
models have a size bound; each Python worker builds them once. Prediction is one narrow pass over whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, bounded_sample, letter_runs, pick


class SuffixAutomaton:
    """All substrings of a text, with how often each occurs."""

    def __init__(self, text: str) -> None:
        nxt: list[dict[str, int]] = [{}]
        link, length, seen = [-1], [0], [0]
        last = 0
        for ch in text:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            seen.append(1)
            p = last
            while p >= 0 and ch not in nxt[p]:
                nxt[p][ch] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][ch]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    twin = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    seen.append(0)
                    while p >= 0 and nxt[p].get(ch) == q:
                        nxt[p][ch] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur
        for i in sorted(range(1, len(nxt)), key=length.__getitem__, reverse=True):
            if link[i] > 0:
                seen[link[i]] += seen[i]
        self.next, self.seen, self.size = nxt, seen, max(1, len(text))
        self.known: dict[str, tuple[int, float]] = {}

    def longest(self, text: str, at: int = 0) -> tuple[int, int]:
        """Length of the longest match from a place on, and how often it occurs."""
        state, n = 0, at
        while n < len(text):
            to = self.next[state].get(text[n])
            if to is None:
                break
            state, n = to, n + 1
        return n - at, self.seen[state] if n > at else 0

    def parse(self, text: str) -> tuple[int, float]:
        """Phrases of a text, and the cost of their rarity; parses of word ends are remembered."""
        known = self.known.get(text)
        if known is not None:
            return known
        nxt, state, n = self.next, 0, 0
        for ch in text:
            to = nxt[state].get(ch)
            if to is None:
                break
            state, n = to, n + 1
        cost = math.log(self.size / self.seen[state]) if n else math.log(self.size) + 3
        rest = text[max(1, n) :]
        if not rest:
            return 1, cost
        phrases, more = self.parse(rest) if len(rest) < 200 else self._parse_long(rest)
        if len(rest) <= 12:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[rest] = phrases, more
        return phrases + 1, cost + more

    def _parse_long(self, text: str) -> tuple[int, float]:
        """The same for a long run of letters, without recursion."""
        at, phrases, cost = 0, 0, 0.0
        while at < len(text):
            n, seen = self.longest(text, at)
            phrases += 1
            cost += math.log(self.size / seen) if n else math.log(self.size) + 3
            at += max(1, n)
        return phrases, cost


def sample_text(text: str) -> str:
    """A text as it is learnt: lower-cased words between single spaces."""
    return " " + " ".join(letter_runs(text.lower())) + " "


class CrossParser:
    """Automata by language, and tables of what each known word costs in each of them."""

    def __init__(self, texts: dict[str, str], most: int = 1_000_000) -> None:
        self.langs = sorted(texts)
        self.automata = [SuffixAutomaton(texts[x]) for x in self.langs]
        self.most = most
        self.clear()

    def clear(self) -> None:
        """Forget all words: the memory is bounded by ``most`` of them."""
        k = len(self.langs)
        self.number: dict[str, int] = {}
        self.phrases, self.cost, self.letters = np.zeros((1024, k), np.int32), np.zeros((1024, k), np.float32), np.zeros(1024, np.int32)

    def _learn(self, words: list[str]) -> None:
        n = len(self.number)
        while n + len(words) > len(self.letters):
            self.phrases, self.cost, self.letters = (np.concatenate([x, np.zeros_like(x)]) for x in (self.phrases, self.cost, self.letters))
        for at, word in enumerate(words, n):
            padded = f" {word} "
            self.number[word] = at
            self.letters[at] = len(padded)
            for i, a in enumerate(self.automata):
                self.phrases[at, i], self.cost[at, i] = a.parse(padded)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text."""
        if len(self.number) > self.most:
            self.clear()
        words = [letter_runs((t or "").lower()) for t in texts]
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        self._learn(list(set().union(*words).difference(self.number)))
        flat = np.fromiter(map(self.number.__getitem__, chain.from_iterable(words)), np.int64)
        ends = np.cumsum([0, *map(len, words)])
        sums = [np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x[flat].astype(np.float64), axis=0)]) for x in (self.phrases, self.cost, self.letters[:, None])]
        phrases, cost, letters = (x[ends[1:]] - x[ends[:-1]] for x in sums)
        return [self._judge(p, c, n) if n else ("und", 0.0) for p, c, n in zip(np.rint(phrases), np.round(cost, 3), letters[:, 0], strict=True)]

    def _judge(self, phrases: np.ndarray, cost: np.ndarray, letters: float) -> tuple[str, float]:
        best = min(range(len(self.langs)), key=lambda i: (phrases[i], cost[i], self.langs[i]))
        # softmax of the normalised counts, sharpened by the number of letters seen
        tie = (phrases == phrases[best]) * np.maximum(0.0, cost - cost[best])
        weights = np.exp(-4.0 * (phrases - phrases[best]) / math.sqrt(letters) - 0.05 * tie)
        return self.langs[best], float(1.0 / weights.sum())


def fit(documents: DataFrame, doc_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs: int = 120, chars: int = 60_000) -> dict[str, str]:
    """The text that each language is known by: documents of the sample up to ``chars`` characters."""
    rows = pick(documents, [(doc_col, "doc_id"), (text_col, "text"), (lang_col, "lang")]).dropna()
    ids = bounded_sample(rows.select("doc_id", "lang").distinct(), "doc_id", "lang", docs).select("doc_id", "lang")
    found = rows.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("lang", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    # of a longer text the driver gets, and a language learns, the first ``chars`` characters
    found = found.select("lang", "doc_id", F.substring("text", 1, chars).alias("text"))
    out: dict[str, str] = {}
    for r in sorted(found.collect(), key=lambda r: (r["lang"], r["doc_id"])):
        have = out.setdefault(r["lang"], "")
        if len(have) < chars:
            out[r["lang"]] = (have + sample_text(r["text"]))[:chars]
    return {k: v for k, v in out.items() if v.strip()}


_parsers: dict[int, CrossParser] = {}


def predict_language(documents: DataFrame, texts: dict[str, str], doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hash(tuple(sorted(shared.value.items())))
        if known not in _parsers:
            _parsers.clear()
            _parsers[known] = CrossParser(shared.value)
        parser = _parsers[known]
        for b in batches_of(batches, rows=500, size=2_000_000):
            found = parser.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found]), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return pick(documents, [(doc_col, "doc_id"), (text_col, "text")]).mapInArrow(run, "doc_id long, lang_pred string, score double")
