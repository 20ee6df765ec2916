"""Language identification by n-gram Bloom filters with language bitmasks.

All languages share one bit-sliced Bloom filter: a slot holds a bitmask of
languages, an n-gram is hashed to HASHES slots, and the AND of their masks
names all languages that contain it. A text's n-grams are looked up once;
the popcounts for each language are corrected for the filter's false
positives (fill ** HASHES of the n-grams would hit by chance), and the
largest corrected count decides. N-grams that all languages contain, such as
those of a line that half the corpus repeats, count for none.

The filter learns from n-gram counts over all training rows. A language
contains an n-gram if its rate there is at least MIN_RATE, which bounds the
n-grams of a language by 1 / MIN_RATE, and at least SHARE of the highest
rate in any language: below that its occurrences there are taken for
quotations and mislabelled rows, not for the language's own.

How sure a prediction is follows from two shares: known, that of a text's
n-grams which its best language contains, and lead, that of the best
language's n-grams among those of the best and the second (only n-grams that
tell languages apart). A text is rejected if it has no letter, or if one of
the two surely (by an upper confidence bound, so few n-grams reject nothing)
lies below SLACK times what all but QUANTILE of the rightly predicted
labelled rows reach. Noise and languages never learned fail by known, texts
of two languages by lead.

Defined results: `und` with score 0 for a null text or one without a letter,
or if nothing was learned; a text without an n-gram that tells languages apart
gets the most frequent training language with score 0; on ties the language that sorts
first wins; rows without text or language teach nothing; if nothing was
learned, only texts without a letter are rejected; repeated rows count each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, STEP_BYTES, chunks, column, row_id, staged

GRAM, HASHES = 4, 3

#: Rates of n-grams: the least one that counts, and the least share of the highest among the languages.
MIN_RATE, SHARE = 2.0**-16, 0.3

#: Slots for each n-gram.
SLOTS = 8

#: The share of rightly predicted rows below the calibration point, how far under it a text has to lie, and the width of
#: the confidence bound in standard deviations.
QUANTILE, SLACK, WIDTH = 0.001, 0.75, 3.0

UNKNOWN = "und"

#: Lower-cases A-Z; every other ASCII byte that is no letter becomes a space.
_FOLD = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in ASCII_LOWER)

_LETTER = re.compile(r"[^\W\d_]")


def pieces(texts: list[bytes], step: int | None = None) -> tuple[list[bytes], np.ndarray]:
    """The folded texts, each between two spaces, in pieces of about step bytes that overlap so that each window lies in one, and the text of each piece."""
    step, out, owner = step or STEP_BYTES, [], []
    for i, t in enumerate(texts):
        data = b" " + t.translate(_FOLD) + b"  "
        cut = [data] if len(data) <= step else [data[a : a + step + GRAM - 1] for a in range(0, len(data) - GRAM + 1, step)]
        out += cut
        owner += [i] * len(cut)
    return out, np.array(owner, np.int64)


def stepped(data: list[bytes]) -> Iterator[list[bytes]]:
    """The pieces, as many at a time as two steps hold."""
    first, size = 0, 0
    for i, d in enumerate(data):
        if i > first and size + len(d) > 2 * STEP_BYTES:
            yield data[first:i]
            first, size = i, 0
        size += len(d)
    if data:
        yield data[first:]


def windows(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, number of the piece) of all windows of GRAM bytes in the pieces."""
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    n = np.array([len(d) for d in data])
    owner = np.repeat(np.arange(len(data)), n)[: len(flat) - GRAM + 1]
    key = flat[: len(flat) - GRAM + 1].copy()
    for i in range(1, GRAM):
        key |= flat[i : len(flat) - GRAM + 1 + i] << np.uint32(8 * i)
    last = np.zeros(len(flat), bool)
    ends = n.cumsum()
    for i in range(1, GRAM):
        last[ends - i] = True
    good = ~last[: len(key)] & (key != 0x20202020)
    return key[good], owner[good]


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, text number) of all windows of GRAM bytes in the folded texts."""
    data, owner = pieces(texts)
    key, of = windows(data)
    return key, owner[of]


def slots(key: np.ndarray, size: int) -> list[np.ndarray]:
    """HASHES slots below size, a power of two, for each key."""
    h = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    bits = np.uint64(size.bit_length() - 1)
    a = h >> np.uint64(64 - int(bits))
    b = ((h >> np.uint64(8)) | np.uint64(1)) & np.uint64(size - 1)
    return [((a + np.uint64(i) * b) & np.uint64(size - 1)).astype(np.int64) for i in range(HASHES)]


@dataclass
class Filter:
    languages: list[str]
    masks: np.ndarray  # (slots, words of the bitmask)
    chance: np.ndarray  # false positives for each language
    fallback: int

    def counts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Corrected popcounts (text, language) of the n-grams that not all languages contain, as those tell nothing; of all
        n-grams; and the number of n-grams of each text."""
        data, of_piece = pieces(texts)
        total, shared, hits = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros((len(texts), len(self.languages)))
        at = 0
        for run in stepped(data):
            for out, found in zip((total, shared, hits), self._hits(run), strict=True):
                np.add.at(out, of_piece[at : at + len(run)], found)
            at += len(run)

        def corrected(hits: np.ndarray, total: np.ndarray) -> np.ndarray:
            return np.maximum(0, (hits - total[:, None] * self.chance) / (1 - self.chance))

        known = corrected(hits, total)
        if len(self.languages) == 1:
            return known, known, total
        return corrected(hits - shared[:, None], total - shared), known, total

    def _hits(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each piece: its n-grams, those of them in all languages, and those in each language."""
        key, owner = windows(data)
        at, n = slots(key, len(self.masks)), len(data)
        hits, common = np.empty((n, len(self.languages))), np.ones(len(key), bool)
        for word in range(self.masks.shape[1]):
            mask = self.masks[at[0], word]
            for more in at[1:]:
                mask = mask & self.masks[more, word]
            bits = 8 * self.masks.itemsize
            here = range(word * bits, min(len(self.languages), (word + 1) * bits))
            common &= mask == self.masks.dtype.type((1 << len(here)) - 1)
            if bits == 8:
                table = np.bincount(owner * 256 + mask, minlength=256 * n).reshape(n, 256)
                for k in here:
                    hits[:, k] = table[:, (np.arange(256) >> (k % bits)) & 1 == 1].sum(1)
            else:
                for k in here:
                    has = (mask >> self.masks.dtype.type(k % bits)) & self.masks.dtype.type(1)
                    hits[:, k] = np.bincount(owner, weights=has, minlength=n)
        return np.bincount(owner, minlength=n), np.bincount(owner, weights=common, minlength=n), hits

    def predict(self, texts: list[bytes | None]) -> list[tuple]:
        """(language, score, has a letter, n-grams, known, n-grams of the two best languages, lead) of each text."""
        out = [(UNKNOWN, 0.0, bool(t) and has_letter(t), 0.0, 0.0, 0.0, 0.0) for t in texts]
        told = [i for i, x in enumerate(out) if x[2]]
        if told and self.languages:
            tell, known, total = self.counts([texts[i] for i in told])
            best, all_tell = tell.argmax(1), tell.sum(1)
            second = np.sort(tell, 1)[:, -2] if len(self.languages) > 1 else np.zeros(len(told))
            for row, i in enumerate(told):
                k = int(best[row]) if all_tell[row] > 0 else self.fallback
                own, two = float(tell[row, k]), float(tell[row, k] + second[row])
                out[i] = (self.languages[k], own / all_tell[row] if all_tell[row] > 0 else 0.0, True, total[row], known[row, k] / total[row] if total[row] else 0.0, two, own / two if two else 0.0)
        return out


def has_letter(text: bytes) -> bool:
    return bool(re.search(rb"[A-Za-z]", text) or _LETTER.search(text.decode("utf-8", "replace")))


def build(languages: list[str], key: np.ndarray, lang: np.ndarray, fallback: int = 0) -> Filter:
    """A filter of (n-gram, language number) pairs."""
    small = len(languages) <= 8
    words = 1 if small else -(-len(languages) // 64)
    size = 1 << max(12, int(SLOTS * len(np.unique(key))).bit_length())
    masks = np.zeros((size, words), np.uint8 if small else np.uint64)
    bits = 8 * masks.itemsize
    for at in slots(key, size):
        for k in range(len(languages)):
            masks[at[lang == k], k // bits] |= masks.dtype.type(1 << (k % bits))
    fill = np.array([((masks[:, k // bits] >> masks.dtype.type(k % bits)) & masks.dtype.type(1)).mean() for k in range(len(languages))])
    return Filter(languages, masks, fill**HASHES, fallback)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Filter:
    """The filter of all rows of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            key, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return key, np.bincount(where, weights=np.concatenate([c for _, c in parts])).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                key, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(key)), pa.array(key.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])
            held.clear()

        for batch in chunks(batches, "t"):
            names = column(batch, "lang").to_pylist()
            texts = [x.as_py() for x in column(batch, "t")]
            for name in dict.fromkeys(names):
                own = pieces([t for t, x in zip(texts, names, strict=True) if x == name])[0]
                parts = held.setdefault(name, [])
                for run in stepped(own):
                    parts.append(np.unique(windows(run)[0], return_counts=True))
                    if len(parts) >= 16:
                        parts[:] = [merged(parts)]
            if sum(len(k) for parts in held.values() for k, _ in parts) > 4_000_000:
                yield from out()
        yield from out()

    rows = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).cast("binary").alias("t"))
    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = staged(counts, "gram-counts")
    totals = sorted((r.lang, r.n) for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect())
    if not totals:
        return Filter([], np.zeros((1, 1), np.uint8), np.zeros(0), 0)
    names = [x for x, _ in totals]
    number = F.create_map(*[F.lit(v) for k, x in enumerate(names) for v in (x, k)])
    sums = F.create_map(*[F.lit(v) for x, n in totals for v in (x, float(n))])
    rated = counts.select("gram", F.try_element_at(number, "lang").alias("k"), (F.col("n") / F.try_element_at(sums, "lang")).alias("rate")).filter(F.col("rate") >= MIN_RATE)
    top = rated.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("k", "rate")).alias("all"))
    pairs = top.select("gram", F.explode("all").alias("x"), "top").filter(F.col("x.rate") >= SHARE * F.col("top")).select("gram", F.col("x.k").alias("k")).toArrow()
    found = build(names, pairs["gram"].to_numpy(), pairs["k"].to_numpy(), max(range(len(totals)), key=lambda k: totals[k][1]))
    return found


_SURE = "letters boolean, grams double, known double, both double, lead double"


def identify(docs: DataFrame, known: Filter, text: str = "text", doc_id: str = "doc_id", lang: str | None = None) -> DataFrame:
    """rid, doc_id, lang_pred, score of every whole text, and how sure that is; lang names a column of true languages that is carried along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "t"):
            found = list(zip(*known.predict([x.as_py() for x in column(batch, "t")]), strict=True))
            kinds = [pa.string(), pa.float64(), pa.bool_(), *[pa.float64()] * 4]
            arrays = [pa.array(x, k) for x, k in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, "rid"), column(batch, "doc_id"), column(batch, "lang"), *arrays], [f.split()[0] for f in schema.split(", ")])

    schema = "rid long, doc_id long, lang string, lang_pred string, score double, " + _SURE
    rows = docs.select(row_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), (F.col(lang) if lang else F.lit(None)).cast("string").alias("lang"), F.col(text).cast("binary").alias("t"))
    return rows.mapInArrow(run, schema)


def floors(found: DataFrame) -> tuple[float, float]:
    """The least known and lead of a text that is not rejected: SLACK times those that all but QUANTILE of the rightly
    predicted labelled rows reach (of a lead what lies over one half counts, as the best language has that much anyway)."""
    right = found.filter((F.col("lang") == F.col("lang_pred")) & (F.col("grams") > 0) & (F.col("both") > 0))
    bins = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.floor(F.col(name) * 1000).alias("bin")) for name in ("known", "lead")]))
    counts = right.select(bins.alias("x")).groupBy("x.name", "x.bin").agg(F.count("*").alias("n")).collect()  # 2002 rows at most
    out = []
    for name in ("known", "lead"):
        own = sorted((r.bin, r.n) for r in counts if r.name == name)
        share = np.cumsum([n for _, n in own]) / max(1, sum(n for _, n in own))
        out.append(own[int(np.searchsorted(share, QUANTILE, "right"))][0] / 1000 if own else 0.0)
    return SLACK * out[0], 0.5 + SLACK * max(0.0, out[1] - 0.5) if out[1] else 0.0


def upper(share: float, grams: float) -> float:
    """The upper confidence bound (Wilson) of a share of overlapping n-grams, GRAM of which are worth an independent one."""
    n = grams / GRAM
    if not n:
        return 1.0
    return (share + WIDTH**2 / (2 * n) + WIDTH * (share * (1 - share) / n + WIDTH**2 / (4 * n * n)) ** 0.5) / (1 + WIDTH**2 / n)


def keeper(known: Filter, least: tuple[float, float]) -> Callable[[Column], Column]:
    """A function of a text column (binary): whether its text has a letter and is, for all that is sure, in one language that
    was learned. least as from floors(). It decides in the scan that keeps the rows, so they need no names and no shuffle."""

    @F.arrow_udf("boolean")
    def keep(texts: pa.Array) -> pa.Array:
        out = []
        for part in chunks([pa.RecordBatch.from_arrays([texts], ["t"])], "t"):
            for _, _, letters, n, share, both, lead in known.predict([x.as_py() for x in column(part, "t")]):
                out.append(bool(letters and upper(min(share, 1.0), n) >= least[0] and upper(lead, both) >= least[1]))
        return pa.array(out, pa.bool_())

    return keep
