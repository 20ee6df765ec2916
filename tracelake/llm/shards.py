"""Contiguous sharding with the smallest possible largest shard.

Groups of equal texts are atomic and ordered: groups above a HOT-th of all
bytes first, then the others by hash. The smallest capacity that a greedy
walk can meet with the given number of shards is found by binary search; the
cuts keep to it, and are as even as it allows.

The driver never sees all groups. It gets the sums of BINS hash ranges and
the few hot groups, bounds the answer and hence where each cut can lie, and
has only the ranges there split further, SPLIT-fold each time, until the
ranges that matter hold FETCH groups or fewer, which it fetches. The capacity
is that of a search over all groups, however many there are.

Defined results: a row's size is the UTF-8 bytes of its text plus 1, a null
text has none and forms a group apart; repeated rows are rows of a group as
any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_id, staged

#: Hash ranges; groups that hold more than one in HOT of all bytes stand alone (so at most HOT of them).
BINS, HOT = 1 << 16, 8192

#: Parts of a range that is split, as a power of two, and groups that the driver fetches at most.
SPLIT, FETCH = 10, 1 << 16

#: Rows of a shard are numbered in up to CELLS parts of about CELL_ROWS rows.
CELLS, CELL_ROWS = 4096, 20_000


def walk(ends: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Greedy cuts over cumulative sizes: the index of each next shard's first item; None if the shards don't suffice."""
    cuts, at, reached = [], 0, 0
    while at < len(ends):
        nxt = int(np.searchsorted(ends, reached + capacity, "right"))
        if nxt == at or len(cuts) == shards:
            return None
        cuts.append(nxt)
        at, reached = nxt, int(ends[nxt - 1])
    return cuts


def smallest_capacity(ends: np.ndarray, shards: int, low: int, high: int) -> int:
    """The least capacity from low to high that the walk can meet; high must be one."""
    while low < high:
        middle = (low + high) // 2
        if walk(ends, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def cut(ends: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Cuts under a capacity that the walk can meet: the index of each next shard's first item.

    Each cut is the one nearest to an even share of what is left, between the
    earliest cut from which the rest still fits and the furthest that the
    capacity allows, so the last shard isn't left with the remainder.
    """
    before = np.concatenate([[0], ends])
    earliest = [len(ends)]
    for _ in range(shards - 1):
        earliest.append(int(np.searchsorted(before, before[earliest[-1]] - capacity, "left")))
    cuts, at = [], 0
    for k, least in zip(range(shards, 0, -1), reversed(earliest), strict=True):
        furthest = int(np.searchsorted(before, before[at] + capacity, "right")) - 1
        share = before[at] + (before[-1] - before[at]) / k
        i = int(np.searchsorted(before, share))
        if i > at and (i == len(before) or share - before[i - 1] < before[i] - share):
            i -= 1
        at = min(max(i, least, at), furthest)
        cuts.append(at)
    return cuts


def _ranges(ends: np.ndarray, coarse: np.ndarray, low: int, high: int, shards: int) -> np.ndarray:
    """The coarse items in which a cut of any capacity from low to high can fall."""
    first = last = 0
    need = np.zeros(len(ends), bool)
    for _ in range(shards):
        i = int(np.searchsorted(ends, first + low, "right"))
        first = int(ends[i - 1]) if i else 0
        last = min(last + high, int(ends[-1]))
        j = int(np.searchsorted(ends, last, "left"))
        need[i : j + 1] = True
    return need & coarse


def _sums(groups: DataFrame, shift: int, inside: list[int] | None = None, of: int = 0) -> list[tuple[int, int, int, int]]:
    """(first hash, size, shift, groups) of the ranges of 2 ** shift hashes, or of those in some ranges of 2 ** of."""
    if inside is not None:
        few = groups.sparkSession.createDataFrame([(x >> of,) for x in inside], "__range long")
        groups = groups.withColumn("__range", F.shiftright("h", of)).join(F.broadcast(few), "__range")
    found = groups.groupBy(F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    return sorted((r.b << shift, r.s, shift if shift else -1, r.n) for r in found)


def plan(groups: DataFrame, shards: int, fetch: int = FETCH) -> tuple[list[tuple[int, int]], list[int], int]:
    """groups: h, size. Returns the hot groups' (h, shard), the first h of the shards that start after them, and the shard of the first other group."""
    total = groups.agg(F.sum("size")).first()[0]
    if not total:
        return [], [], 0
    is_hot = F.col("size") > max(1, total // HOT)
    hot = sorted((r.h, r["size"]) for r in groups.filter(is_hot).collect())
    rest = groups.filter(~is_hot)
    top = 64 - (BINS - 1).bit_length()
    # Items in order: (first h, size, shift of a range or -1 for a single group, groups).
    items = [(h, s, -1, 1) for h, s in hot] + _sums(rest, top)
    low, high = max(-(-total // shards), max((s for _, s in hot), default=0)), total
    need = np.ones(len(items), bool)
    while True:
        sizes = np.array([s for _, s, _, _ in items], np.int64)
        coarse = np.array([x >= 0 for _, _, x, _ in items])
        ends = sizes.cumsum()
        # Cuts fall into needed ranges only, so rounding them up costs no more than the largest of these.
        high = smallest_capacity(ends, shards, low, high)
        low = max(low, high - int(sizes[coarse & need].max(initial=0)))
        need = _ranges(ends, coarse, low, high, shards)
        wanted = [items[i] for i in np.flatnonzero(need)]
        if not wanted:
            break
        # Ranges of one size at a time; those that stay as they are keep their place.
        shift = max(x for _, _, x, _ in wanted)
        split = {h for h, _, x, _ in wanted if x == shift}
        finer = 0 if sum(n for _, _, x, n in wanted if x == shift) <= fetch else max(0, shift - SPLIT)
        parts = _sums(rest, finer, sorted(split), shift)
        after = sorted([x for x in items[len(hot) :] if not (x[2] == shift and x[0] in split)] + parts)
        needed = {x[0] for x in parts} | {x[0] for x in wanted}
        items = items[: len(hot)] + after
        need = np.array([False] * len(hot) + [x[0] in needed for x in after])
    cuts = cut(ends, high, shards)
    starts = [0, *cuts[:-1]]
    shard_of = lambda i: int(np.searchsorted(starts, i, "right")) - 1
    hot_shard = [(h, shard_of(i)) for i, (h, _) in enumerate(hot)]
    return hot_shard, [items[i][0] for i in starts if len(hot) < i < len(items)], shard_of(len(hot)) if len(items) > len(hot) else 0


def _placed(rows: DataFrame, plan_: tuple, out: str) -> DataFrame:
    """rows with h, and their shard."""
    hot, starts, first = plan_
    shard = F.lit(first)
    for h in starts:
        shard = shard + (F.col("h") >= F.lit(h)).cast("int")
    if hot:
        few = rows.sparkSession.createDataFrame(hot, "h long, __hot int")
        rows = rows.join(F.broadcast(few), "h", "left")
        return rows.withColumn(out, F.coalesce("__hot", shard).cast("int")).drop("__hot")
    return rows.withColumn(out, shard.cast("int"))


def assign(docs: DataFrame, shards: int = 16, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: rid, doc_id, size, text_crc32, h, shard, slot (gapless within the shard)."""
    data = F.col(text).cast("binary")
    size = (F.coalesce(F.octet_length(data), F.lit(0)) + 1).cast("long")
    rows = docs.select(row_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), size.alias("size"), F.coalesce(F.crc32(data), F.lit(0)).alias("text_crc32"), F.xxhash64(F.col(text)).alias("h"))
    rows = staged(rows, "shard-rows")
    groups = staged(rows.groupBy("h").agg(F.sum("size").alias("size")), "shard-groups")
    placed = _placed(rows, plan(groups, shards), "shard")
    cells = max(16, min(CELLS, rows.count() // (CELL_ROWS * shards)))
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("rid"), F.lit(cells)).cast("int"))
    counts = sorted((r.shard, r.cell, r["count"]) for r in placed.groupBy("shard", "cell").count().collect())
    offsets, at, of = [], 0, None
    for shard, cell, n in counts:
        at = at if shard == of else 0
        offsets.append((shard, cell, at))
        at, of = at + n, shard
    offset = docs.sparkSession.createDataFrame(offsets, "shard int, cell int, before long")
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("h", "rid"))
    numbered = placed.withColumn("n", number).join(F.broadcast(offset), ["shard", "cell"])
    return numbered.select("rid", "doc_id", "size", "text_crc32", "h", "shard", (F.col("before") + F.col("n") - 1).cast("long").alias("slot"))


def write(docs: DataFrame, path: str, shards: int = 16, text: str = "text") -> None:
    """Writes docs, all columns, in a folder for each shard."""
    rows = docs.withColumn("h", F.xxhash64(F.col(text)))
    size = (F.coalesce(F.octet_length(F.col(text).cast("binary")), F.lit(0)) + 1).cast("long")
    groups = staged(docs.select(F.xxhash64(F.col(text)).alias("h"), size.alias("size")).groupBy("h").agg(F.sum("size").alias("size")), "shard-groups")
    _placed(rows, plan(groups, shards), "shard").drop("h").write.partitionBy("shard").parquet(path)
