"""Packing token sequences into windows by Karmarkar-Karp differencing.

A document's ids are cut into whole windows as far as they reach, which need
no packing; what is left is cut into even pieces of at most PIECE ids. The
pieces are dealt by hash into batches of about BATCH windows. In a batch,
pieces under BUNDLE ids are joined to bundles, so however short the documents
are it has a few thousand items at most; multiway differencing starts from one partial partition for each item and
merges the two with the largest difference, the largest sums of one meeting
the smallest of the other, until one partition is left. If its largest sum
exceeds the window, the number of windows rises by one and it starts again.

Ids are those of the tokenizers library with its defaults, without special
tokens put in: an added token of the file, such as an end marker, that stands
in a text gets its own id.

Defined results: a null text is empty and is its end id alone; repeated rows
are packed each; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import functools
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, partitions, row_id, staged

WINDOW, PIECE, BATCH, BUNDLE = 2048, 512, 64, 96

_PIECES = "rid long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def karmarkar_karp(sizes: list[int], ways: int) -> list[list[int]]:
    """Item numbers in ways groups of near-equal sums, the largest sum first."""
    heap, tie = [], 0
    for i, size in enumerate(sizes):
        sums = np.zeros(ways, np.int64)
        sums[0] = size
        heap.append((-size, tie := tie + 1, sums, [[i], *[[]] * (ways - 1)]))
    if not heap:
        return [[] for _ in range(ways)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, of_a = heapq.heappop(heap)
        _, _, b, of_b = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        of = [of_a[k] + of_b[ways - 1 - k] for k in order.tolist()]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), tie := tie + 1, sums, of))
    return heap[0][3]


def bundled(sizes: list[int], least: int = BUNDLE) -> list[list[int]]:
    """Items of at least that size (the last one may be less): pieces, and runs of smaller pieces."""
    out, run, total = [], [], 0
    for i, size in enumerate(sizes):
        if size >= least:
            out.append([i])
            continue
        run.append(i)
        total += size
        if total >= least:
            out.append(run)
            run, total = [], 0
    return out + [run] if run else out


def pack(sizes: list[int], window: int = WINDOW) -> list[list[int]]:
    """The fewest windows, from the sum's bound up, that differencing can fill without exceeding one."""
    items = bundled(sizes, min(BUNDLE, max(1, window // 8)))
    weights = [sum(sizes[i] for i in x) for x in items]
    ways = max(1, -(-sum(sizes) // window))
    while True:
        groups = karmarkar_karp(weights, ways)
        if max(sum(weights[k] for k in g) for g in groups) <= window:
            return [[i for k in g for i in items[k]] for g in groups if g]
        ways += 1


def cuts(n: int, window: int = WINDOW, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole windows, then even pieces of the rest."""
    whole = n - n % window
    out = [(a, window) for a in range(0, whole, window)]
    rest = n - whole
    if rest:
        k = -(-rest // piece)
        edges = [whole + rest * i // k for i in range(k + 1)]
        out += [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    return out


@functools.cache
def tokenizer(path: str, pattern: str):
    """text -> ids, as the tokenizer in a json file gives them to text in which its added tokens mean nothing.

    A byte-level BPE whose ids are its ranks runs on tiktoken, which gives
    the same ids in a fraction of the time; any other file on tokenizers.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    vocab = model.get("vocab", {})
    made = [vocab.get(a + b, -1) for a, b in merges]
    if "ByteLevel" in json.dumps(spec.get("pre_tokenizer")) and not spec.get("normalizer") and made and made == sorted(set(made)) and made[0] == 256:
        import tiktoken

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        special = {x["content"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(shown[c] for c in t): i for t, i in vocab.items() if t not in special}
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return lambda text: own.encode(text, add_special_tokens=False).ids


@functools.cache
def encoder(path: str, pattern: str):
    """text -> ids, as Tokenizer.from_file(path).encode(text, add_special_tokens=False) gives them.

    Only texts that hold one of the file's added tokens, which get their own
    ids, need the library itself; the others run on tokenizer().
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = [x["content"] for x in spec.get("added_tokens", [])]
    plain = tokenizer(path, pattern)

    @functools.cache
    def whole():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    if spec.get("normalizer"):  # added tokens may be found in the normalised text
        return lambda text: whole().encode(text, add_special_tokens=False).ids
    return lambda text: whole().encode(text, add_special_tokens=False).ids if any(x in text for x in added) else plain(text)


def pieces(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The pieces of every document, with the checksum of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, pattern)
        for batch in batches:
            out: list[list[int]] = [[] for _ in range(6)]
            for rid, doc, x in zip(column(batch, "rid").to_pylist(), column(batch, "doc_id").to_pylist(), column(batch, "t"), strict=True):
                x = x.as_py()
                ids = np.array([*(encode(x) if x else ()), end_id], "<u4")
                for a, n in cuts(len(ids)):
                    for k, v in enumerate((rid, doc, a, n, zlib.crc32(ids[a : a + n]), len(ids))):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], [f.split()[0] for f in _PIECES.split(", ")])

    rows = docs.select(row_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"))
    return rows.mapInArrow(run, _PIECES)


def pack_documents(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    rows = staged(pieces(docs, tokenizer_path, pattern, end_id, text, doc_id), "pieces")
    rest = rows.filter(F.col("length") < WINDOW).agg(F.sum("length")).first()[0] or 0
    batches = max(1, -(-rest // (BATCH * WINDOW)))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            number = int(t["batch"][0].as_py())
            length = t["length"].to_numpy()
            small = np.flatnonzero(length < WINDOW)
            sequence, offset = np.empty(len(length), np.int64), np.zeros(len(length), np.int64)
            whole = np.flatnonzero(length == WINDOW)
            sequence[whole] = np.arange(len(whole))
            for k, group in enumerate(pack(length[small].tolist()) if len(small) else [], len(whole)):
                at = 0
                for i in small[group].tolist():
                    sequence[i], offset[i] = k, at
                    at += int(length[i])
            t = t.select(names[:5]).append_column("sequence_id", pa.array((number << 32) + sequence)).append_column("offset", pa.array(offset))
            return t.combine_chunks().to_batches()[0]

        for part in parts:
            key = column(part, "batch").to_numpy()
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in zip(edges, edges[1:], strict=False):
                if held and held[0]["batch"][0].as_py() != key[a]:
                    yield done()
                    held.clear()
                if b > a:
                    held.append(part.slice(a, b - a))
        if held:
            yield done()

    dealt = rows.withColumn("batch", F.pmod(F.xxhash64("rid", "start"), F.lit(batches)))
    dealt = dealt.repartition(min(partitions(spark) * 2, max(1, batches)), "batch").sortWithinPartitions("batch", "rid", "start")
    return dealt.mapInArrow(run, schema)
