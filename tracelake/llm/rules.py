"""Quality rules, and an isolation forest on their statistics.

The base rules look at words `[^\\x20\\x09-\\x0D]+` of the whole text. The
forest sees ratios of the same counts and of marks at words (never lengths of
texts, so long and short documents are alike to it): trees split random features at random values,
and a document that few splits set apart is anomalous. Every tree counts all
good labelled rows. The threshold on the forest's score comes from all
labelled rows: it rejects as many of low quality as
it can, where a lost good row weighs GOOD_WEIGHT times a caught bad one.

Defined results: a null text has no words and fails the base rules, as does
an empty one; repeated rows are judged alike; labels of unknown documents,
null labels and contradicting labels (the lowest counts) do no harm; without
labels of both kinds nothing but the base rules rejects; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import placed
from .common import STEP_BYTES, chunks, column, release, row_id, staged, word_parts

WINDOW = 5

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: SAMPLE: the rows that a tree's nodes are weighed against, all rows counting as so many. GOOD_WEIGHT: how much a rejected share of the good rows weighs against a rejected share of the bad ones.
TREES, SAMPLE, GOOD_WEIGHT = 200, 256, 20.0

#: Mean word lengths over LONG count as LONG.
LONG = 64.0

#: The range of the features of marks and of the ratios of the counts, and of all features.
BOX = (np.zeros(5), np.array([4.0, 1, 1, 1, 1]))
RATIO_BOX = (np.zeros(3), np.array([LONG, 1, 1]))
FULL_BOX = tuple(np.concatenate(x) for x in zip(BOX, RATIO_BOX, strict=True))

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbols_per_word", "end_mark_share", "lone_share", "again_share", "caps_share", "word_length", "dup_line_share", "repeat_share")


_MARKS = frozenset(bytes([c]) for c in range(33, 127) if not chr(c).isalnum())


def repeat_words(ids: np.ndarray, kinds: int, k: int = WINDOW) -> int:
    """Words that lie in a window of k words found twice or more; ids below kinds stand for the words."""
    n = len(ids) - k + 1
    if n < 2:
        return 0
    key, have, base = ids[:n].astype(np.int64), 1, max(2, kinds)
    for i in range(1, k):
        if have > (1 << 62) // base:
            _, key = np.unique(key, return_inverse=True)
            have = int(key.max()) + 1
        key = key * base + ids[i : i + n]
        have *= base
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    if not len(same):
        return 0
    edge = np.zeros(len(ids) + 1, np.int32)
    twice = np.unique(np.concatenate([order[same], order[same + 1]]))
    edge[twice] += 1
    edge[twice + k] -= 1
    return int((edge[:-1].cumsum() > 0).sum())


def analysed(text: bytes) -> tuple[list[int], list[float], np.ndarray]:
    """The base counts and the forest's features of a text in UTF-8, and numbers that stand for its words, from 0 in the order of first sight.

    Words are read some at a time, so that a very long text takes no more than some bytes a word.
    """
    seen: dict[bytes, int] = {}
    ids, end_marks, lone, caps = [], 0, 0, 0
    by = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if len(text) <= STEP_BYTES else sum(np.bincount(np.frombuffer(text[a : a + STEP_BYTES], np.uint8), minlength=256) for a in range(0, len(text), STEP_BYTES))
    capitals = by[65:91].any()
    for words in word_parts(text):
        ids.append(np.fromiter([seen.setdefault(w, len(seen)) for w in words], np.int64, len(words)))
        last = bytes([w[-1] for w in words])
        end_marks += len(last) - len(last.translate(None, b"!?;:#*$%&|<>+=/\\~^_@"))
        lone += sum([len(w) == 1 and w in _MARKS for w in words])
        caps += sum([w.isupper() and len(w) > 1 for w in words]) if capitals else 0
    ids = np.concatenate(ids) if len(ids) > 1 else ids[0]
    n = len(ids)
    if not n:
        return [0] * 5, [0.0] * len(FEATURES), ids
    word_chars = int(by.sum() - by[0x80:0xC0].sum() - by[0x20] - by[9:14].sum())
    symbols = int(sum(by[ord(c)] for c in SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.split(None, 1)] if b"\n" in text else [text]
    dup_lines, repeats = len(lines) - len(set(lines)), repeat_words(ids, len(seen))
    again = int((ids[1:] == ids[:-1]).sum())
    per = [min(4.0, symbols / n), end_marks / n, lone / n, again / n, caps / n, min(LONG, word_chars / n), dup_lines / len(lines), repeats / n]
    return [n, word_chars, symbols, dup_lines, repeats], per, ids


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """The base counts and the forest's features of a text in UTF-8."""
    return analysed(text)[:2]


def measured(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """rid, doc_id, the base counts and the features (array<double>) of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "t"):
            found = [statistics(x.as_py() or b"") for x in column(batch, "t")]
            counts = [pa.array([c[k] for c, _ in found], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([column(batch, "rid"), column(batch, "doc_id"), *counts, pa.array([f for _, f in found], pa.list_(pa.float64()))], ["rid", "doc_id", *COUNTS, "features"])

    rows = docs.select(row_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t"))
    return rows.mapInArrow(run, "rid long, doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", features array<double>")


@dataclass
class Forest:
    """Trees as arrays over nodes; leaves have feature -1 and the path length in cut."""

    feature: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    roots: np.ndarray
    mean: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Isolation score from 0 to 1, near 1 for anomalies."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := self.feature[at] >= 0).any():
                f = np.where(inner, self.feature[at], 0)
                step = np.where(x[rows, f] < self.cut[at], self.low[at], self.high[at])
                at = np.where(inner, step, at)
            total += self.cut[at]
        return 2.0 ** (-total / len(self.roots) / max(self.mean, 1e-9))


def usual_path(n: np.ndarray | float) -> np.ndarray | float:
    """Mean path length of an unsuccessful search in a tree of n items; n need not be whole."""
    more = np.maximum(n, 2.0)
    long = 2 * (np.log(more - 1) + 0.5772156649015329) - 2 * (more - 1) / more
    return np.where(np.less_equal(n, 2), np.maximum(np.subtract(n, 1), 0.0), np.maximum(long, 1.0))


def random_trees(box: tuple[np.ndarray, np.ndarray], depth: int, trees: int = TREES, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Feature and cut of all inner nodes of full trees, a row for each tree, the children of node i at 2i + 1 and 2i + 2.
    Splits are uniform over the node's part of the box, so no row is needed to draw them: a statistic that is the same in
    all rows still sets documents apart that lie elsewhere in the box."""
    rng = np.random.default_rng(seed)
    feature = rng.integers(len(box[0]), size=(trees, 2**depth - 1)).astype(np.int8)
    share = rng.random(feature.shape)
    cut = np.empty(feature.shape)
    for t in range(trees):
        low, high = box[0][None], box[1][None]
        for d in range(depth):
            at, nodes = slice(2**d - 1, 2 ** (d + 1) - 1), np.arange(2**d)
            f = feature[t, at]
            cut[t, at] = low[nodes, f] + share[t, at] * (high[nodes, f] - low[nodes, f])
            low, high = low.repeat(2, 0), high.repeat(2, 0)
            high[2 * nodes, f] = low[2 * nodes + 1, f] = cut[t, at]
    return feature, cut


def fallen(x: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """How many rows of x fall into each leaf of each of random_trees()."""
    rows, inner = np.arange(len(x)), feature.shape[1]
    out = np.zeros((len(feature), inner + 1), np.int64)
    for t in range(len(feature)):
        at = np.zeros(len(x), np.int64)
        while len(at) and at[0] < inner:
            at = 2 * at + 1 + (x[rows, feature[t, at]] >= cut[t, at])
        out[t] = np.bincount(at - inner, minlength=inner + 1) if len(at) else 0
    return out


def usual_depth(n: int, sample: int = SAMPLE) -> int:
    return int(np.ceil(np.log2(max(2, min(sample, n))))) + 4


def pruned(feature: np.ndarray, cut: np.ndarray, leaves: np.ndarray, sample: int = SAMPLE) -> Forest:
    """The isolation forest of random_trees() over all rows counted in leaves. A node of c among n rows weighs what it holds
    of a sample in the mean, c * sample / n, and is split while that is over 1: no row is left out, and none is drawn."""
    trees, inner = feature.shape
    n = int(leaves[0].sum())
    sample = min(sample, n)
    size = np.concatenate([np.zeros((trees, inner), np.int64), leaves], 1)
    for i in reversed(range(leaves.shape[1].bit_length() - 1)):
        at = np.arange(2**i - 1, 2 ** (i + 1) - 1)
        size[:, at] = size[:, 2 * at + 1] + size[:, 2 * at + 2]
    split = size[:, :inner] * sample > n
    there = np.ones(size.shape, bool)
    there[:, 1::2] = there[:, 2::2] = split
    number = there.ravel().cumsum().reshape(size.shape) - 1
    depth = np.floor(np.log2(np.arange(1, size.shape[1] + 1)))
    f, c = np.full(size.shape, -1), depth + usual_path(size * (sample / n))
    low, high = np.zeros(size.shape, np.int64), np.zeros(size.shape, np.int64)
    f[:, :inner][split], c[:, :inner][split] = feature[split], cut[split]
    low[:, :inner][split], high[:, :inner][split] = number[:, 1::2][split], number[:, 2::2][split]
    return Forest(f[there], c[there], low[there], high[there], number[:, 0].copy(), float(usual_path(sample)))


def grow(x: np.ndarray, box: tuple[np.ndarray, np.ndarray], trees: int = TREES, sample: int = SAMPLE, seed: int = 0) -> Forest:
    """A forest over all of x."""
    feature, cut = random_trees(box, usual_depth(len(x), sample), trees, seed)
    return pruned(feature, cut, fallen(x, feature, cut), sample)


def calibrate(score: np.ndarray, bad: np.ndarray, weight: float = GOOD_WEIGHT) -> float:
    """The threshold with the largest (share of bad rows at or over it - weight * that share of good rows), halfway to the
    next row below it; infinite if none is better than rejecting nothing, or if rows of one kind are missing."""
    if not len(score) or not bad.any() or bad.all():
        return float("inf")
    order = np.argsort(-score, kind="stable")
    s, b = score[order], bad[order]
    gain = b.cumsum() / b.sum() - weight * (~b).cumsum() / (~b).sum()
    ends = np.flatnonzero(np.append(s[1:] < s[:-1], True))
    at = ends[np.argmax(gain[ends])]
    if gain[at] <= 0:
        return float("inf")
    return float((s[at] + s[at + 1]) / 2) if at + 1 < len(s) else float(s[at])


def calibrated(scores: DataFrame, weight: float = GOOD_WEIGHT) -> float:
    """calibrate() over all rows of a table (score, bad), in ranges of the score; the driver gets a row for each range."""
    per = scores.groupBy("score").agg(F.count_if("bad").alias("b"), F.count_if(~F.col("bad")).alias("g"))
    ranges = placed(per, [F.desc("score")])
    sums = sorted(tuple(r) for r in ranges.groupBy("__p").agg(F.sum("b"), F.sum("g"), F.max("score")).collect())
    bad, good = sum(r[1] for r in sums), sum(r[2] for r in sums)
    if not bad or not good:
        release(ranges)
        return float("inf")
    before = [(p, sum(r[1] for r in sums[:i]), sum(r[2] for r in sums[:i]), sums[i + 1][3] if i + 1 < len(sums) else None) for i, (p, *_) in enumerate(sums)]
    before = scores.sparkSession.createDataFrame(before, "__p int, b0 long, g0 long, after double")
    order = Window.partitionBy("__p").orderBy(F.desc("score"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    b, g = F.col("b0") + F.sum("b").over(so_far), F.col("g0") + F.sum("g").over(so_far)
    gain = b.cast("double") / F.lit(float(bad)) - F.lit(float(weight)) * g.cast("double") / F.lit(float(good))
    below = F.coalesce(F.lead("score").over(order), "after")
    best = ranges.join(F.broadcast(before), "__p").select(gain.alias("gain"), "score", below.alias("below")).orderBy(F.desc("gain"), F.desc("score")).first()
    release(ranges)
    if best.gain <= 0:
        return float("inf")
    return best.score if best.below is None else (best.score + best.below) / 2


def _features(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(column(batch, "features").to_pylist()).reshape(batch.num_rows, len(FEATURES))


def fit(rows: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality") -> tuple[Forest | None, float]:
    """A forest over all good labelled rows that pass the base rules, and its threshold from all labelled rows that do.
    rows as from measured(). The driver gets one count for each leaf that any row falls into."""
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(quality).cast("int").alias("q")).dropna().groupBy("doc_id").agg(F.min("q").alias("q"))
    # Of rows that repeat an id the one with the least features counts, so the forest is the same each time.
    found = rows.filter(~base_failed()).select("doc_id", "features").join(known, "doc_id").groupBy("doc_id").agg(F.min("features").alias("features"), (F.first("q") == 0).alias("bad"))
    found = staged(found, "labelled")
    n = found.filter(~F.col("bad")).count()
    if not n:
        release(found)
        return None, float("inf")
    feature, cut = random_trees(FULL_BOX, usual_depth(n))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(feature), feature.shape[1] + 1), np.int64)
        for batch in batches:
            total += fallen(_features(batch), feature, cut)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["leaf", "n"])

    per_leaf = found.filter(~F.col("bad")).select("features").mapInArrow(counted, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).toArrow()
    leaves = np.zeros((len(feature), feature.shape[1] + 1), np.int64)
    leaves.ravel()[per_leaf["leaf"].to_numpy()] = per_leaf["n"].to_numpy()
    forest = pruned(feature, cut, leaves)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(forest.score(_features(batch))), column(batch, "bad")], ["score", "bad"])

    threshold = calibrated(found.mapInArrow(scored, "score double, bad boolean"))
    release(found)
    return forest, threshold


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def keeper(forest: Forest | None, threshold: float) -> Callable[[Column], Column]:
    """A function of a text column (binary): whether its text passes the base rules and lies under the forest's threshold.
    It decides in the scan that keeps the rows, so they need no names and no shuffle."""

    @F.arrow_udf("boolean")
    def keep(texts: pa.Array) -> pa.Array:
        out = []
        for part in chunks([pa.RecordBatch.from_arrays([texts], ["t"])], "t"):
            found = [statistics(x.as_py() or b"") for x in column(part, "t")]
            score = forest.score(np.array([f for _, f in found])) if forest is not None else np.zeros(len(found))
            out += [n >= 10 and 100 * repeats <= 20 * n and bool(s < threshold) for ((n, _, _, _, repeats), _), s in zip(found, score, strict=True)]
        return pa.array(out, pa.bool_())

    return keep


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """rid, doc_id, the base counts, base_failed, kept and the forest's score of every document."""
    rows = staged(measured(docs, text, doc_id), "rule-statistics")
    forest, threshold = fit(rows, labels)
    schema = "rid long, doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, anomaly double"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _features(batch)
            score = forest.score(x) if forest is not None and len(x) else np.zeros(len(x))
            failed = column(batch, "base_failed").to_numpy(zero_copy_only=False)
            kept = ~failed & (score < threshold)
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names[:-2]), pa.array(kept), pa.array(score)], names)

    return rows.withColumn("base_failed", base_failed()).mapInArrow(run, schema)
