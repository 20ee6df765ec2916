"""Byte-level BPE encoding by prefix dynamic programming, and decoding.

For every prefix of a piece the table holds the one token that ends the
prefix's encoding. A token t = piece[i:j] is that token exactly if the pair
(last token of the prefix i, t) survives merging, so a prefix costs a few
dictionary lookups, the encoding of any prefix is read off backwards, bytes
appended later extend the table, and an edit rebuilds it from the edit on.

Texts are cut into pieces by the tokenizer's pattern first. Defined results:
a null text counts as empty and has no tokens; special tokens' strings are
ordinary text; repeated rows are encoded alike; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column

#: Words that one generation of a worker's cache holds; pairs have four times as many entries.
CACHE = 500_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_MARKS = frozenset(".,;:!?")


class PrefixBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        parts = pattern.split("|")
        self._letters = r" ?\p{L}+" in parts and r" ?[^\s\p{L}\p{N}]+" in parts and all(p[:1] == "'" for p in parts[: parts.index(r" ?\p{L}+")])
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.size_of = {v: len(k) for k, v in ranks.items()}
        self.longest = max(self.size_of.values(), default=1)
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[int, bool] = {}  # by left << 32 | right
        self._tables: dict[bytes, list[int]] = {}  # of prefixes seen before

    # -- the rule for a pair ------------------------------------------------
    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that merge into token last, None for a byte or a token that merging never makes."""
        if token not in self._halves:
            parts = self._merged(self.bytes_of[token], self.ranks[self.bytes_of[token]])
            self._halves[token] = tuple(parts) if len(parts) == 2 else None
        return self._halves[token]

    def _merged(self, b: bytes, below: int) -> list[int]:
        """b merged by the ranks under a bound; for short byte strings only."""
        parts = [b[i : i + 1] for i in range(len(b))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def survives(self, left: int, right: int) -> bool:
        """Whether left, right stay apart: no merge across their border comes before the border's own sides are made.

        The border is walked from the outermost merges inwards: at every
        moment the younger side is the one made later, and a pair across the
        border must not have a rank that wins before it.
        """
        key = left << 32 | right
        if (known := self._pairs.get(key)) is not None:
            return known
        if len(self._pairs) > 4 * CACHE:
            self._pairs.clear()
        a, b, bound, fine = left, right, 1 << 60, True
        while True:
            joined = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if joined is not None and joined < bound:
                fine = False
                break
            # Undo the later merge; on equal ranks the left one came first, so the right side goes.
            ha, hb = self.halves(a), self.halves(b)
            if ha is not None and (hb is None or a > b):
                bound, a = a, ha[1]
            elif hb is not None:
                bound, b = b + 1, hb[0]
            else:
                break
        self._pairs[key] = fine
        return fine

    # -- the table of a piece -----------------------------------------------
    def extend(self, piece: bytes, table: list[int]) -> list[int]:
        """table holds the last token of the prefixes 1 to len(table) of piece; adds the rest.

        Only one token can end a prefix's encoding, so the order in which they are tried doesn't matter; short ones are more often right.
        """
        get, pairs = self.ranks.get, self._pairs.get
        for j in range(len(table) + 1, len(piece) + 1):
            for i in range(j - 1, max(-1, j - 1 - self.longest), -1):
                token = get(piece[i:j])
                if token is None:
                    continue
                if i:
                    if (fine := pairs(table[i - 1] << 32 | token)) is None:
                        fine = self.survives(table[i - 1], token)
                    if not fine:
                        continue
                elif j > 1 and self.halves(token) is None:
                    continue  # merging never makes it
                table.append(token)
                break
        return table

    def table(self, piece: bytes) -> list[int]:
        """The piece's table, begun from the longest prefix that an earlier piece had."""
        n = len(piece)
        if n > 48:
            return self.extend(piece, [])
        tables = self._tables
        for k in range(n, 0, -1):
            if (known := tables.get(piece[:k])) is not None:
                if k == n:
                    return known
                break
        else:
            k, known = 0, []
        if len(tables) > CACHE:
            tables.clear()
        found = self.extend(piece, known[:k])
        for j in range(k + 1, n + 1):
            tables[piece[:j]] = found  # a longer piece's table serves its prefixes: only what lies within is read
        return found

    def read(self, table: list[int], end: int | None = None) -> list[int]:
        """The encoding of the prefix of length end."""
        out, j, size = [], len(table) if end is None else end, self.size_of
        while j:
            token = table[j - 1]
            out.append(token)
            j -= size[token]
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.read(self.table(piece), len(piece))

    # -- texts --------------------------------------------------------------
    def pieces(self, text: str) -> list[str]:
        """The pattern's matches; a word of letters after a space, a mark behind it or not, needs no matching."""
        if self._letters and text[:1] == " ":
            if text[1:].isalpha():
                return [text]
            if text[-1] in _MARKS and text[1:-1].isalpha():
                return [text[:-1], text[-1]]
        return self.pattern.findall(text)

    def encode(self, text: str) -> list[int]:
        return [t for p in self.pieces(text) for t in self.encode_piece(p.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


class Encoded:
    """A text with its pieces and their ids, for appends and edits that encode only what they touch.

    A match of the pattern depends on the text from its start on, and looks
    at most one character past its end, so pieces well before an edit stay,
    and after it matching is in step again as soon as a boundary is an old one.
    """

    BACK = 2  # pieces before an edit whose end may depend on it

    def __init__(self, bpe: PrefixBPE, text: str = ""):
        self.bpe, self.text = bpe, ""
        self.starts: list[int] = []
        self.ids_of: list[list[int]] = []
        self.fresh = 0  # pieces encoded so far
        self.edit(0, 0, text)

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces text[start:end] by new."""
        from bisect import bisect_left, bisect_right

        text, moved = self.text[:start] + new + self.text[end:], len(new) - (end - start)
        first = max(0, bisect_right(self.starts, start) - 1 - self.BACK)
        at = self.starts[first] if self.starts else 0
        old = self.starts[bisect_left(self.starts, end) :]
        resume = {s + moved: i for i, s in enumerate(old, len(self.starts) - len(old))}
        starts, ids, tail = self.starts[:first], self.ids_of[:first], len(self.starts)
        for m in self.bpe.pattern.finditer(text, at):
            if m.start() >= start + len(new) and m.start() in resume:
                tail = resume[m.start()]
                break
            starts.append(m.start())
            ids.append(self.bpe.encode_piece(m[0].encode()))
            self.fresh += 1
        self.starts = starts + [s + moved for s in self.starts[tail:]]
        self.ids_of = ids + self.ids_of[tail:]
        self.text = text

    @property
    def ids(self) -> list[int]:
        return [t for ids in self.ids_of for t in ids]


def words(text: str) -> list[str]:
    """The text cut before each space that a non-space follows, which is a border of pieces in patterns that let a piece begin with one space."""
    if "\0" in text or _SPACES.search(text):
        return _WORD.findall(text)
    return text.replace(" ", "\0 ").split("\0")


_SPACES = regex.compile(r" (?:\s|\Z)")
_WORD = regex.compile(r"(?: (?=\S)|(?! (?=\S))[\s\S])(?:(?! (?=\S))[\s\S])*+")


class WordCache:
    """Encoded words in two generations: a full one becomes the old one, and what is found there moves up."""

    def __init__(self, bpe: PrefixBPE):
        self.bpe = bpe
        self.young: dict[str, tuple[str, bytes]] = {}
        self.old: dict[str, tuple[str, bytes]] = {}

    def all(self, words: list[str]) -> list[tuple[str, bytes]]:
        """(decimal ids joined by a space, the bytes that they decode to) of each word."""
        get, add = self.young.get, self.add
        out = [get(w) or add(w) for w in words]
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        return out

    def add(self, word: str) -> tuple[str, bytes]:
        found = self.old.get(word)
        if found is None:
            ids = self.bpe.encode(word)
            found = " ".join(map(str, ids)), self.bpe.decode(ids)
        if len(word) < 64:
            self.young[word] = found
        return found


@functools.cache
def word_cache(ranks_path: str, pattern: str) -> WordCache:
    """One for a worker, whichever tasks it runs."""
    return WordCache(PrefixBPE(load_ranks(ranks_path), pattern))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", doc_id: str = "doc_id", ids: bool = False, at_spaces: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, and the ids themselves if asked for.

    at_spaces says that in this pattern a piece begins at every space before
    a non-space, as in those of the public byte-level tokenizers; without it
    a text is cut by the pattern alone, which is slower.

    ids_sha256 is of the decimal ids joined by a space, decoded_sha256 of the
    bytes that the ids decode to.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_cache(ranks_path, pattern)
        for batch in batches:
            n, idsha, decsha, lists = [], [], [], []
            for x in column(batch, "t"):
                x = x.as_py() or ""
                parts = known.all(words(x) if at_spaces else [x]) if x else []
                decimal = " ".join([p[0] for p in parts])
                n.append(decimal.count(" ") + 1 if decimal else 0)
                idsha.append(hashlib.sha256(decimal.encode()).hexdigest())
                decsha.append(hashlib.sha256(b"".join([p[1] for p in parts])).hexdigest())
                if ids:
                    lists.append([int(i) for i in decimal.split()])
            arrays = [column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(idsha, pa.string()), pa.array(decsha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                arrays, names = [*arrays, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, ranks_path: str, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text of lists of ids; null ids give an empty text, bytes that are no UTF-8 the replacement character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {v: k for k, v in load_ranks(ranks_path).items()}
        for batch in batches:
            out = [b"".join([of[i] for i in x or []]).decode("utf-8", "replace") for x in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, text string")
