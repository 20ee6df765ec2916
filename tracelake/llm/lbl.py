"""Language-model scoring by a log-bilinear model trained with noise-contrastive estimation.

The most frequent words and the end of text each have vectors of their own;
they are dealt to CLASSES classes of SLOTS members, by their ending as far
as there is room. The first member of a class stands for all rarer words of
its endings. The model predicts the next word from the CONTEXT words before
it, in two steps that are both log-bilinear,

    P(word | context) = softmax over classes of (q . out[class] + bias[class])
                      * softmax over the class's members of (q . out[member] + bias[member]),
    q = sum over positions j of scale[j] * inp[word before by j],

and a rare word has its add-one share of its class's rare training tokens,
one more share being kept for words never seen. All factors sum to one, so a
score is the log10 probability of the text. Scoring normalises over all
classes, and over all members of the target's class, by batched matrix
products.

Training counts all words of all training rows (a shuffle that grows with
the corpus), codes every row as word numbers, and deals the coded rows by a
hash of their content to shards of about SHARD_TOKENS tokens. In each of
ROUNDS synchronous rounds every shard takes its next part of the rows, fits
a copy of the round's model to it by noise-contrastive estimation, with
noise drawn from the frequencies, and the copies (and the step sizes they
reached) are averaged by tokens. Shards, their order and their seeds depend
on the rows alone, not on files, tasks or executors, and the steps of a
round don't become fewer as the corpus and the shards grow. The driver holds
the HEAD most frequent words and the model; counts of all other words meet
the texts' rarer words in a sort-merge join.

The model's size is fixed (4,032 words, 16 wide), as its cost per token is;
what is gathered from the corpus, the counts and all rarer words' shares,
grows with it.

Defined results: a null or empty text is its end alone; with no training
rows the shares are those of add-one counts of nothing; repeated rows and repeated or null ids
are scored row by row; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, column, partitions, row_id, staged, word_parts

#: Classes, members of a class (the first stands for its rare words), width of the vectors, words of context.
CLASSES, SLOTS, WIDTH, CONTEXT = 64, 64, 16, 4
WORDS = CLASSES * SLOTS

#: Words that the driver sends to all tasks with their counts.
HEAD = 1 << 17

#: Noise classes and noise members of a step, step size, least and most tokens of a step, and steps that a shard shall take if
#: it has the tokens: small corpora take smaller steps.
NOISE, SLOT_NOISE, RATE, LEAST_STEP, STEP, STEPS = 16, 8, 0.1, 256, 4096, 512

#: Synchronous rounds, tokens of a shard over all rounds, tokens that a shard shuffles at once.
ROUNDS, SHARD_TOKENS, BLOCK = 4, 1 << 22, 1 << 18

#: Positions that are normalised at once: they stay in a core's cache.
ROWS = 1024

#: Entries of a task's counter before it is flushed, and bytes of a text that are split into words at once.
COUNTER, SPAN = 600_000, 1 << 20

END = b""

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def tokens(text: bytes | None) -> list[bytes]:
    """Words of the lower-cased text (bytes.split parts at \\x20 and \\x09-\\x0D), then the end."""
    return [*(text or b"").translate(ASCII_LOWER).split(), END]


def spans(text: bytes | None) -> Iterator[list[bytes]]:
    """tokens(text) in parts, so that a very long text takes no more memory."""
    held: list[bytes] = []
    for part in word_parts((text or b"").translate(ASCII_LOWER), SPAN):
        if held:
            yield held
        held = part
    yield [*held, END]


def bucket(word: bytes) -> int:
    """The class of a word by its ending."""
    return zlib.crc32((word.rstrip(_PUNCTUATION) or word)[-3:]) % CLASSES


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word (binary), bucket, c: all tokens of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = list(seen)
            found = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([bucket(w) for w in words], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["word", "bucket", "c"])
            seen.clear()
            return found

        for batch in batches:
            for x in column(batch, "t"):
                for part in spans(x.as_py()):
                    seen.update(part)
                    if len(seen) > COUNTER:
                        yield out()
        yield out()

    rows = docs.select(F.col(text).cast("binary").alias("t")).mapInArrow(run, "word binary, bucket int, c long")
    return rows.groupBy("word", "bucket").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """What tasks know of the words: the head's numbers and counts, and what rare words of a class share.

    number is a head word's place in the model: class * SLOTS + member, the
    member being 0 for a rare word; its last entry serves words not in the
    head. log_size is the log10 denominator of a class's rare words.
    """

    index: dict[bytes, int]
    number: np.ndarray
    counts: np.ndarray
    below: int  # words with fewer training tokens are not in the head
    log_size: np.ndarray
    share: np.ndarray  # of training tokens, for each place in the model
    n: int
    v: int

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(head number or -1, place in the model) of each word."""
        get = self.index.get
        head = np.fromiter([get(w, -1) for w in words], np.int32, len(words))
        of = self.number[head]
        for i in np.flatnonzero(head < 0).tolist():
            of[i] = bucket(words[i]) * SLOTS
        return head, of


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """From staged counts; at most head words come to the driver."""
    of_counts = counts.groupBy("c").count().orderBy(F.desc("c")).limit(head).collect()
    below, held = 1 << 62, 0
    for r in of_counts:
        if held + r["count"] > head:
            break
        below, held = r.c, held + r["count"]
    top = counts.filter(F.col("c") >= below).select("word", "c").toArrow().to_pydict()
    order = sorted(range(len(top["word"])), key=lambda i: (-top["c"][i], top["word"][i]))
    order = [i for i in order if bytes(top["word"][i]) != END]
    words = [END] + [bytes(top["word"][i]) for i in order]
    by_bucket = {r.bucket: (r.c, r.v) for r in counts.filter(F.col("word") != F.lit(END)).groupBy("bucket").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
    ends = counts.filter(F.col("word") == F.lit(END)).agg(F.sum("c")).first()[0] or 0
    n, v = ends + sum(c for c, _ in by_bucket.values()), (ends > 0) + sum(x for _, x in by_bucket.values())
    count = np.array([ends] + [top["c"][i] for i in order], np.int64)

    size, mass = np.ones(CLASSES), np.zeros(WORDS)
    for b, (c, x) in by_bucket.items():
        size[b] += c + x
        mass[b * SLOTS] += c
    number, used = np.empty(len(words) + 1, np.uint16), np.ones(CLASSES, int)
    for i, w in enumerate(words):
        home = bucket(w)
        if i < CLASSES * (SLOTS - 1):  # a member of its own, in the next class with room
            k = next(k for k in ((home + j) % CLASSES for j in range(CLASSES)) if used[k] < SLOTS)
            number[i], mass[k * SLOTS + used[k]] = k * SLOTS + used[k], count[i]
            used[k] += 1
            if i:
                size[home] -= count[i] + 1
                mass[home * SLOTS] -= count[i]
        else:
            number[i] = home * SLOTS
    there = np.arange(SLOTS) < used[:, None]  # members that stand for nothing have no share
    mass = np.where(there.ravel(), mass + 1, 0)
    return Vocabulary({w: i for i, w in enumerate(words)}, number, np.append(count, 0), below, np.log10(size), mass / mass.sum(), int(n), int(v))


@dataclass
class Model:
    inp: np.ndarray  # (WORDS + 1, WIDTH); the last stands before the text
    classes: np.ndarray
    class_bias: np.ndarray
    members: np.ndarray
    member_bias: np.ndarray  # so low for members that stand for nothing that they have no probability
    scale: np.ndarray

    @staticmethod
    def start(share: np.ndarray, seed: int = 0) -> Model:
        """Small random vectors; biases that give the shares."""
        rng = np.random.default_rng(seed)
        small = lambda n: rng.normal(0, 0.3 / np.sqrt(WIDTH), (n, WIDTH)).astype(np.float32)
        of_class = share.reshape(CLASSES, SLOTS).sum(1)
        within = (share.reshape(CLASSES, SLOTS) / of_class[:, None]).ravel()
        member_bias = np.where(within > 0, np.log(np.maximum(within, 1e-30)), -50)
        return Model(small(WORDS + 1), small(CLASSES), np.log(of_class).astype(np.float32), small(WORDS), member_bias.astype(np.float32), np.ones((CONTEXT, WIDTH), np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.inp, self.classes, self.class_bias, self.members, self.member_bias, self.scale]

    def query(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """q for the positions at of the framed words flat."""
        q = self.inp[flat[at - 1]] * self.scale[0]
        for j in range(1, CONTEXT):
            q += self.inp[flat[at - 1 - j]] * self.scale[j]
        return q

    def log_probs(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 P(word | words before) at the positions, normalised over all classes and all members of the class."""
        target = flat[at]
        order = np.argsort(target, kind="stable")  # class by class, so that a class's members are one matrix product
        out = np.empty(len(at))
        of_class = target[order] // SLOTS
        edges = np.searchsorted(of_class, np.arange(CLASSES + 1))
        for a in range(0, len(at), ROWS):
            part = order[a : a + ROWS]
            q = self.query(flat, at[part])
            log = _log_softmax(q @ self.classes.T + self.class_bias, of_class[a : a + ROWS])
            for k in range(of_class[a], of_class[min(a + ROWS, len(at)) - 1] + 1):
                low, high = max(int(edges[k]) - a, 0), min(int(edges[k + 1]) - a, len(part))
                if high > low:
                    own = slice(k * SLOTS, (k + 1) * SLOTS)
                    log[low:high] += _log_softmax(q[low:high] @ self.members[own].T + self.member_bias[own], target[part[low:high]] % SLOTS)
            out[part] = log
        return out / np.log(10)


def _log_softmax(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log probability of one entry of each row; logits are overwritten."""
    own = logits[np.arange(len(at)), at].astype(float)
    top = 0.0
    if max(-logits.min(), logits.max()) > 60:  # beyond single precision: with the largest taken out
        top = logits.max(1)
        logits -= top[:, None]
    np.exp(logits, out=logits)
    return own - top - np.log((logits @ np.ones(logits.shape[1], np.float32)).astype(float))


def runs(key: np.ndarray) -> np.ndarray:
    """Where a sorted key changes."""
    return np.flatnonzero(np.append(True, key[1:] != key[:-1]))


def spread(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sum of the rows for each index below n."""
    order = np.argsort(index, kind="stable")
    at = index[order]
    first = runs(at)
    out = np.zeros((n, rows.shape[1]), np.float32)
    out[at[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def pull(score: np.ndarray) -> np.ndarray:
    """1 - sigmoid: how far a score is raised that should be high."""
    return 1 / (1 + np.exp(np.clip(score, -30, 30)))


class Trainer:
    """Noise-contrastive estimation with noise shared by a step, and AdaGrad steps. Noise members are drawn as slots, which
    hold words of like frequency in all classes."""

    def __init__(self, model: Model, sums: list[np.ndarray], share: np.ndarray, seed: int, tokens: int = STEP):
        self.tokens = tokens
        self.model = Model(*(p.copy() for p in model.parts()))
        self.sums = [p.copy() for p in sums]
        self.rng = np.random.default_rng(seed)
        table = share.reshape(CLASSES, SLOTS)
        self.class_share, self.slot_share = table.sum(1), table.sum(0)
        self.log_class, self.log_slot = (np.log(n * np.maximum(p, 1e-30)).astype(np.float32) for n, p in ((NOISE, self.class_share), (SLOT_NOISE, self.slot_share)))
        self.there = share > 0
        self.seen = 0

    def step(self, flat: np.ndarray, at: np.ndarray) -> None:
        m, n = self.model, len(at)
        at = at[np.argsort(flat[at], kind="stable")]
        word = flat[at]
        of_class, slot = word // SLOTS, word % SLOTS
        q = m.query(flat, at)
        noise, slots = self.rng.choice(CLASSES, NOISE, p=self.class_share), self.rng.choice(SLOTS, SLOT_NOISE, p=self.slot_share)

        hit, miss = m.classes[of_class], m.classes[noise]
        up = (pull(np.einsum("ij,ij->i", q, hit) + m.class_bias[of_class] - self.log_class[of_class]) / n).astype(np.float32)
        down = (-pull(-(q @ miss.T + (m.class_bias[noise] - self.log_class[noise]))) / n).astype(np.float32)
        to_q = up[:, None] * hit + down @ miss

        hit = m.members[word]
        up2 = (pull(np.einsum("ij,ij->i", q, hit) + m.member_bias[word] - self.log_slot[slot]) / n).astype(np.float32)
        table = m.members.reshape(CLASSES, SLOTS, WIDTH)[:, slots]
        bias = m.member_bias.reshape(CLASSES, SLOTS)[:, slots] - self.log_slot[slots]
        first = runs(of_class)
        there, ends = of_class[first], np.append(first[1:], n)
        blocks = list(zip(there.tolist(), first.tolist(), ends.tolist(), strict=True))  # a class's tokens: one matrix product each
        scores = bias[of_class]
        for k, a, b in blocks:
            scores[a:b] += q[a:b] @ table[k].T
        down2 = (-pull(-scores) / n).astype(np.float32)
        to_q += up2[:, None] * hit
        apart = np.empty((len(first), SLOT_NOISE, WIDTH), np.float32)
        for i, (k, a, b) in enumerate(blocks):
            to_q[a:b] += down2[a:b] @ table[k]
            np.matmul(down2[a:b].T, q[a:b], out=apart[i])

        classes, class_bias = np.zeros_like(m.classes), np.zeros_like(m.class_bias)
        members, member_bias = np.zeros_like(m.members), np.zeros_like(m.member_bias)
        classes[there] = np.add.reduceat(up[:, None] * q, first, axis=0)
        class_bias[there] = np.add.reduceat(up, first)
        np.add.at(classes, noise, down.T @ q)
        np.add.at(class_bias, noise, down.sum(0))
        own = runs(word)
        members[word[own]] = np.add.reduceat(up2[:, None] * q, own, axis=0)
        member_bias[word[own]] = np.add.reduceat(up2, own)
        of_noise = there[:, None].astype(np.int64) * SLOTS + slots
        np.add.at(members, of_noise, apart)
        np.add.at(member_bias, of_noise, np.add.reduceat(down2, first, axis=0))
        members[~self.there], member_bias[~self.there] = 0, 0

        inp, scale = np.zeros_like(m.inp), np.empty_like(m.scale)
        for j in range(CONTEXT):
            of = spread(flat[at - 1 - j], to_q, WORDS + 1)
            inp += of * m.scale[j]
            scale[j] = np.einsum("ij,ij->j", of, m.inp)
        for p, s, g in zip(m.parts(), self.sums, (inp, classes, class_bias, members, member_bias, scale), strict=True):
            s += g * g
            g /= np.sqrt(s)
            g *= RATE
            p += g
        self.seen += n

    def train(self, rows: list[np.ndarray]) -> None:
        flat, at = framed(rows)
        at = at[self.rng.permutation(len(at))]
        for a in range(0, len(at), self.tokens):
            self.step(flat, at[a : a + self.tokens])


def framed(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(words, positions that count) of rows of words, with what stands before a text put before each."""
    pad = np.full(CONTEXT, WORDS, np.uint16)
    flat = np.concatenate([x for r in rows for x in (pad, r)]) if rows else pad
    n = np.array([len(r) for r in rows], np.int64)
    starts = np.cumsum(n + CONTEXT) - n
    return flat, (np.arange(n.sum()) + np.repeat(starts - (n.cumsum() - n), n)).astype(np.int32 if len(flat) < 1 << 31 else np.int64)


def _packed(parts: list[np.ndarray]) -> bytes:
    return np.concatenate([p.ravel() for p in parts]).astype("<f4").tobytes()


def _unpacked(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    out, at = [], 0
    for p in like:
        out.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
        at += p.size
    return out


_OWN = "ids binary, n_tokens long, head_known long, head_log double, rest_log double, rest_size double, rare array<struct<word: binary, n: long>>"
_RARE = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))


def coded(docs: DataFrame, words: Vocabulary, text: str = "text", extra: dict[str, Column] | None = None, key: str | None = None) -> DataFrame:
    """rid, h, the extra columns, the text as places in the model, and sums over its words.

    h is a hash of the text, and of the column key if one is named: it deals
    copies of a text that have other keys to other shards.
    """
    extra = extra or {}
    kinds = dict(docs.select(*[c.alias(k) for k, c in extra.items()]).dtypes) if extra else {}
    schema = ", ".join(["rid long, h long", *(f"`{k}` {t}" for k, t in kinds.items()), _OWN])
    names = ["rid", "h", *kinds, *(f.split()[0] for f in ("ids", "n_tokens", "head_known", "head_log", "rest_log", "rest_size", "rare"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_count = np.log10(words.counts + 1.0)

        def one(text: bytes | None) -> tuple:
            ids, n, known, of_head, of_rest, size = [], 0, 0, 0.0, 0.0, 0.0
            rare: Counter[bytes] = Counter()
            for part in spans(text):
                head, of = words.ids(part)
                there, rest = head >= 0, of % SLOTS == 0
                log = log_count[head]  # 0 for words not in the head
                ids.append(of.tobytes())
                n += len(part)
                known += int((words.counts[head] > 0).sum())
                of_head += float(log.sum())
                of_rest += float(log[rest].sum())
                size += float(words.log_size[of[rest] // SLOTS].sum())
                rare.update(part[i] for i in np.flatnonzero(~there).tolist())
            return b"".join(ids), n, known, of_head, of_rest, size, [{"word": w, "n": k} for w, k in rare.items()]

        for batch in batches:
            held: list[tuple] = []
            first = size = 0
            for i, x in enumerate(column(batch, "__t")):
                held.append(one(x.as_py()))
                size += len(held[-1][0]) + 64 * len(held[-1][-1])
                if size > 4 << 20 or i + 1 == batch.num_rows:
                    part = batch.slice(first, i + 1 - first)
                    own = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), _RARE), strict=True)]
                    yield pa.RecordBatch.from_arrays([*(column(part, c) for c in ("rid", "h", *kinds)), *own], names)
                    held, first, size = [], i + 1, 0

    of = [F.col(text)] + ([F.col(key).cast("string")] if key else [])
    rows = docs.select(row_id().alias("rid"), F.xxhash64(*of).alias("h"), *[c.alias(k) for k, c in extra.items()], F.col(text).cast("binary").alias("__t"))
    return rows.mapInArrow(run, schema)


def train(rows: DataFrame, words: Vocabulary) -> Model:
    """The model fitted to all of the coded rows."""
    model, share = Model.start(words.share), words.share
    sums = [np.full(p.shape, 1e-4, np.float32) for p in model.parts()]
    shards = max(1, -(-words.n // SHARD_TOKENS))
    tokens = min(STEP, max(LEAST_STEP, words.n // shards // STEPS))
    place = F.pmod(F.xxhash64("h"), F.lit(shards * ROUNDS))
    dealt = rows.select((place % shards).cast("int").alias("shard"), F.floor(place / shards).alias("round"), "h", "ids")

    def fitted(now: int, model: Model, sums: list[np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trainer, shard, held, size = None, None, [], 0

            def done() -> pa.RecordBatch:
                trainer.train(held)
                state = _packed(trainer.model.parts() + trainer.sums)
                return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([trainer.seen], pa.int64()), pa.array([state], pa.binary())], ["shard", "n", "state"])

            for batch in batches:
                for k, x in zip(column(batch, "shard").to_pylist(), column(batch, "ids"), strict=True):
                    if k != shard:
                        if trainer:
                            yield done()
                        trainer, shard, held, size = Trainer(model, sums, share, k * ROUNDS + now, tokens), k, [], 0
                    held.append(np.frombuffer(x.as_py(), np.uint16))
                    size += len(held[-1])
                    if size >= BLOCK:
                        trainer.train(held)
                        held, size = [], 0
            if trainer:
                yield done()

        return run

    def averaged(states: DataFrame, kind: str, parts: int) -> DataFrame:
        """The states in that many groups, each averaged by tokens, in an order of its own, so that rounding doesn't depend on tasks."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n, part = 0, 0, 0
            for batch in batches:
                for shard, k, state in zip(column(batch, "shard").to_pylist(), column(batch, "n").to_pylist(), column(batch, "state"), strict=True):
                    total, n, part = total + k * np.frombuffer(state.as_py(), kind).astype(float), n + k, shard % parts
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([(total / n).astype("<f8").tobytes()], pa.binary())], ["shard", "n", "state"])

        return states.repartitionById(parts, F.col("shard") % parts).sortWithinPartitions("shard").mapInArrow(run, schema)

    schema = "shard int, n long, state binary"
    for now in range(ROUNDS):
        own = dealt.filter(F.col("round") == now).select("shard", "h", "ids").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "h")
        states = staged(own.mapInArrow(fitted(now, model, sums), schema), "lbl-states")
        some = averaged(states, "<f4", min(shards, max(AVERAGES, partitions(rows.sparkSession))))
        found = sorted(averaged(some, "<f8", AVERAGES).collect(), key=lambda r: r.shard)
        if n := sum(r.n for r in found):
            parts = _unpacked(sum(r.n / n * np.frombuffer(r.state, "<f8") for r in found), model.parts() + sums)
            model, sums = Model(*parts[: len(parts) // 2]), parts[len(parts) // 2 :]
    return model


#: Averages of the shards' models that reach the driver; they are those of as many averages as the session has partitions.
AVERAGES = 4


def scored(rows: DataFrame, counts: DataFrame, words: Vocabulary, model: Model) -> DataFrame:
    """rid, the extra columns, n_tokens, n_known, train_tokens, base_score, score of staged coded rows."""
    inner = {f.split()[0].strip("`") for f in ("ids", "n_tokens", "head_known", "head_log", "rest_log", "rest_size", "rare", "h", "rid")}
    kinds = [c for c in rows.columns if c not in inner]
    types = dict(rows.dtypes)
    sums = ["n_tokens", "head_known", "head_log", "rest_log", "rest_size"]
    names = ["rid", *kinds, *sums, "neural"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x.as_py(), np.uint16) for x in column(batch, "ids")]
            found, a = np.empty(len(ids)), 0
            while a < len(ids):  # some rows at a time; a longer row alone, position by position
                b, size = a, 0
                while b < len(ids) and (b == a or size + len(ids[b]) <= BLOCK):
                    size += len(ids[b])
                    b += 1
                flat, at = framed(ids[a:b])
                if b == a + 1:
                    found[a] = sum(model.log_probs(flat, at[k : k + BLOCK]).sum() for k in range(0, len(at), BLOCK))
                else:
                    n = np.array([len(x) for x in ids[a:b]])
                    found[a:b] = np.add.reduceat(model.log_probs(flat, at), n.cumsum() - n)
                a = b
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names[:-1]), pa.array(found)], names)

    schema = ", ".join(f"`{c}` {types.get(c, 'double')}" for c in names)
    neural = staged(rows.select("rid", *kinds, *sums, "ids").mapInArrow(run, schema), "neural")
    rare = rows.select("rid", F.inline("rare"))
    others = counts.filter(F.col("c") < words.below).select("word", "c")
    seen = rare.join(others, "word", "left").select("rid", "n", F.coalesce("c", F.lit(0)).alias("c"))
    seen = seen.groupBy("rid").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("rare_log"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return neural.join(seen, "rid", "left").select(
        "rid", *kinds, "n_tokens", (F.col("head_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"), F.lit(words.n).cast("long").alias("train_tokens"),
        (F.col("head_log") + rare_log - F.col("n_tokens") * F.lit(float(np.log10(words.n + words.v + 1)))).alias("base_score"),
        (F.col("neural") + F.col("rest_log") + rare_log - F.col("rest_size")).alias("score"),
    )


def fit(docs: DataFrame, text: str = "text", key: str | None = None) -> tuple[DataFrame, Vocabulary, Model]:
    """Counts, vocabulary and model of all rows of docs."""
    counts = staged(word_counts(docs, text), "word-counts")
    words = vocabulary(counts)
    return counts, words, train(staged(coded(docs, words, text, key=key), "coded"), words)


def score(docs: DataFrame, counts: DataFrame, words: Vocabulary, model: Model, text: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """rid, the extra columns, n_tokens, n_known, train_tokens, base_score, score of every whole text."""
    return scored(staged(coded(docs, words, text, extra), "coded"), counts, words, model)


def fit_and_score(docs: DataFrame, learn: Column, text: str = "text", extra: dict[str, Column] | None = None, key: str | None = None) -> DataFrame:
    """score() of all rows by a model of the rows that learn holds for; every text is coded once for both."""
    counts = staged(word_counts(docs.filter(learn), text), "word-counts")
    words = vocabulary(counts)
    rows = staged(coded(docs, words, text, (extra or {}) | {"__learn": learn}, key), "coded")
    model = train(rows.filter("__learn"), words)
    return scored(rows.drop("__learn"), counts, words, model)
