"""Quality classification from weak labels.

Overlapping heuristics vote good, bad or nothing on every document. Their
accuracies are unknown; expectation-maximisation over the counts of vote
patterns of all documents estimates, for each heuristic and class, how often
it votes what. The posteriors of the patterns then label a sample of
documents, on which a linear scorer over hashed features is trained: byte
trigrams and the votes. The scorer decides.

Only counts of vote patterns (3 ** heuristics at most) and the bounded
training sample reach the driver. Votes are cast once: the texts are written
with them, and the scorer reads both.

Defined results: a null or empty text has no features but its votes, and is
judged by them; repeated rows are judged alike; if all documents vote alike,
or the table is empty, nothing is rejected; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, STEP_BYTES, chunks, column, row_id, staged
from .rules import analysed

#: Hashed features, and documents that train the scorer (a sample by hash of all documents).
BUCKETS, MAX_TRAIN = 2048, 8000

ROUNDS, STEPS, RATE, DECAY = 200, 300, 0.05, 1e-4

#: A document is kept if its score is at least this.
LEAST = 0.5

#: Words in a window of the variety heuristic.
SPAN = 400

HEURISTICS = ("length", "symbols", "end_marks", "lone_marks", "again", "repeats", "duplicate_lines", "caps", "word_length", "variety", "sentences")


def variety(words: Sequence) -> float:
    """How few words repeat, over all words and alike for short and long texts: the lesser of two measures. words may be
    any values that stand for them.

    The first is the mean share of distinct words in windows of SPAN words
    that cover the text (the last one ends with it). It can't see a list of
    more than SPAN words come back, so the second sets the distinct words of
    the whole text against the square root of its length (Guiraud's measure,
    scaled to the share of distinct words at SPAN words). Up to SPAN words
    both are that share.
    """
    ids = words if isinstance(words, np.ndarray) else np.unique(words, return_inverse=True)[1]
    n = len(ids)
    if n <= SPAN:
        return len(np.unique(ids)) / n
    whole = (n - 1) // SPAN
    inside = np.sort(np.concatenate([ids[: whole * SPAN], ids[n - SPAN :]]).reshape(whole + 1, SPAN), axis=1)
    distinct = (whole + 1) + int((inside[:, 1:] != inside[:, :-1]).sum())
    return min(distinct / (SPAN * (whole + 1)), len(np.unique(ids)) / (n * SPAN) ** 0.5)


def votes(text: bytes) -> list[int]:
    """1 good, -1 bad, 0 nothing, for each heuristic."""
    (n, chars, _, dup_lines, repeats), (symbols, end_marks, lone, again, caps, *_), ids = analysed(text)
    if not n:
        return [-1] + [0] * (len(HEURISTICS) - 1)
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    varied = variety(ids)
    ended = sum(x.rstrip().endswith((b".", b"!", b"?", b":")) for x in lines) / len(lines)

    def judge(bad: bool, good: bool) -> int:
        return -1 if bad else 1 if good else 0

    return [
        judge(n < 10, n >= 40),
        judge(symbols > 0.15, symbols < 0.02),
        judge(end_marks > 0.2, end_marks < 0.05),
        judge(lone > 0.15, lone < 0.03),
        judge(again > 0.25, n >= 20 and again < 0.06),
        judge(repeats > 0.2 * n, n >= 40 and repeats < 0.05 * n),
        judge(dup_lines > 0.3 * len(lines), len(lines) > 3 and dup_lines == 0),
        judge(caps > 0.3, n >= 20 and caps < 0.1),
        judge(not 2.5 <= chars / n <= 12, 3.5 <= chars / n <= 7),
        judge(n >= 30 and varied < 0.3, varied > 0.55),
        judge(ended < 0.2, ended > 0.7),
    ]


@dataclass
class LabelModel:
    """share of good documents, and for (class, heuristic) the probabilities of the votes -1, 0, 1."""

    good: float
    rates: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The probability of a good document for each row of votes."""
        which = np.arange(patterns.shape[1])
        log = np.log([[1 - self.good], [self.good]]) + np.stack([np.log(self.rates[c, which, patterns + 1]).sum(1) for c in (0, 1)])
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """EM from a majority vote; class 1 is the one that the heuristics call good."""
    vote = patterns.sum(1)
    p = np.where((patterns < 0).sum(1) * 2 > (patterns > 0).sum(1), 0.1, 0.9) if len(vote) else np.zeros(0)
    model = LabelModel(0.9, np.full((2, patterns.shape[1], 3), 1 / 3))
    for _ in range(rounds):
        rates = np.empty_like(model.rates)
        for c, weight in ((0, counts * (1 - p)), (1, counts * p)):
            for v in (-1, 0, 1):
                rates[c, :, v + 1] = ((patterns == v) * weight[:, None]).sum(0) + 0.5
        rates /= rates.sum(2, keepdims=True)
        model = LabelModel(float(np.clip((counts * p).sum() / max(1, counts.sum()), 0.01, 0.99)), rates)
        new = model.posterior(patterns)
        if len(new) == 0 or np.abs(new - p).max() < 1e-6:
            break
        p = new
    return model


def hashed(texts: list[bytes], of_votes: np.ndarray) -> np.ndarray:
    """(text, BUCKETS) shares of hashed byte trigrams, square roots taken, and the votes in places of their own."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    places = BUCKETS - 3 * len(HEURISTICS)
    for i, t in enumerate(texts):
        if len(t) < 3:
            continue
        count = np.zeros(places)
        for a in range(0, len(t) - 2, STEP_BYTES):  # a step of trigrams at a time
            b = np.frombuffer(t[a : a + STEP_BYTES + 2].translate(ASCII_LOWER), np.uint8).astype(np.uint32)
            key = (b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(2654435761)
            count += np.bincount((key >> np.uint32(8)) % places, minlength=places)
        out[i, :places] = np.sqrt(count / (len(t) - 2))
    which = places + 3 * np.arange(len(HEURISTICS)) + 1
    out[np.arange(len(texts))[:, None], which + of_votes] = 0.3
    return out


def train(x: np.ndarray, p: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Weights, and the bias last, of a logistic regression on probabilities."""
    w, m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, steps + 1):
        error = 1 / (1 + np.exp(-(x @ w[:-1].astype(np.float32) + w[-1]))) - p
        g = np.append(x.T @ error.astype(np.float32) / len(x) + DECAY * w[:-1], error.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _read(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray]:
    """(texts, votes) of a batch of the staged votes."""
    of_votes = np.frombuffer(b"".join(column(batch, "votes").to_pylist()), np.uint8).reshape(-1, len(HEURISTICS))
    return [x.as_py() or b"" for x in column(batch, "t")], of_votes.astype(int) - 1


def classify(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = LEAST) -> DataFrame:
    """rid, doc_id, posterior (of the label model), score (of the scorer), kept of every whole text."""
    rows = docs.select(row_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "t"):
            found = [bytes(v + 1 for v in votes(x.as_py() or b"")) for x in column(batch, "t")]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("rid", "doc_id", "t")), pa.array(found, pa.binary())], ["rid", "doc_id", "t", "votes"])

    # The texts are written with their votes, which cost more than writing them does.
    voted = staged(rows.mapInArrow(vote, "rid long, doc_id long, t binary, votes binary"), "votes")
    counted = voted.groupBy("votes").count().orderBy("votes").collect()
    n = sum(r["count"] for r in counted)
    patterns = np.array([[v - 1 for v in r.votes] for r in counted], int).reshape(-1, len(HEURISTICS))
    model = estimate(patterns, np.array([r["count"] for r in counted], float))

    sample = F.pmod(F.xxhash64("rid"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, MAX_TRAIN / max(1, n)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "t"):
            texts, of_votes = _read(batch)
            x, p = hashed(texts, of_votes), model.posterior(of_votes)
            yield pa.RecordBatch.from_arrays([column(batch, "rid"), pa.array(p), pa.array([r.astype("<f2").tobytes() for r in x], pa.binary())], ["rid", "p", "x"])

    found = voted.filter(sample).mapInArrow(features, "rid long, p double, x binary").orderBy("rid").toArrow() if len(patterns) > 1 else None
    weights = None
    if found is not None and len(found):
        x = np.stack([np.frombuffer(b, "<f2") for b in found["x"].to_pylist()]).astype(np.float32)
        weights = train(x, found["p"].to_numpy())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "t"):
            texts, of_votes = _read(batch)
            p = model.posterior(of_votes)
            s = np.ones(len(texts))
            for a in range(0, len(texts) if weights is not None else 0, 512):
                part = slice(a, a + 512)
                s[part] = 1 / (1 + np.exp(-np.clip(hashed(texts[part], of_votes[part]) @ weights[:-1].astype(np.float32) + weights[-1], -500, 500)))
            yield pa.RecordBatch.from_arrays([column(batch, "rid"), column(batch, "doc_id"), pa.array(p), pa.array(s), pa.array(s >= least)], ["rid", "doc_id", "posterior", "score", "kept"])

    return voted.mapInArrow(score, "rid long, doc_id long, posterior double, score double, kept boolean")
