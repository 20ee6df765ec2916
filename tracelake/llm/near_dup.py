"""Similarity join on word shingles by a MinHash LSH forest, with exact verification.

Texts with the same set of shingles are one node. A tree of the forest is a
prefix trie over signatures of DEPTH minima, held as its sorted list of
leaves: all trees' (tree, signature, node) are range-partitioned and sorted,
and a trie node at depth x is a run of neighbours that share a prefix of
length x. Its texts are candidates. Runs are found in one pass over the
sorted rows; a run that crosses ranges is joined up by its ends, so a run of
any size is spread over as many tasks as it fills.

A link of similarity s shares a prefix of length x in some of t trees with
probability 1 - (1 - s**x)**t, least at the threshold. Prefixes are
shortened, from the whole signature on, until a link at the threshold itself
is found with the target's probability; where one minimum is still too long,
trees are added. Candidates of a length are candidates of all shorter ones,
so only the last length is verified. No table's mix of similarities, such as
one large group of near copies, makes links just over the threshold rarer.
All candidates are verified exactly.

Candidates are linked to one text of their run, never to each other, and
the connected candidates are verified together in blocks: a large set is cut
into chunks, each pair of chunks is a task's unit, and shingle sets are
compared by sparse counting there. Only link counts and a spanning forest of
the links leave a block, so no pair list is ever made, and no candidate is
dropped.

Defined results: words are split at ASCII white space after lower-casing
A-Z; a text of fewer words than a shingle is one shingle; a null, empty or
wordless text is similar to none, not even to another such; equal texts and
repeated rows are links of similarity 1; a null doc_id never is a class id
unless all ids of the class are null; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, column, join_counted, numbered, partitions, release, staged, without
from .graph import components
from .shingles import mix, minima, sets, shingle_hashes

THRESHOLD, TARGET = 0.8, 0.9995

#: Trees of the forest, and minima in a signature.
TREES, DEPTH = 16, 6

#: A chunk of a candidate set has about so many texts or bytes of shingles.
CHUNK_TEXTS, CHUNK_BYTES = 512, 16 << 20


def found_share(s: np.ndarray | float, depth: int, trees: int = TREES):
    """The probability that a link of similarity s shares a prefix of this depth in some tree."""
    return 1 - (1 - np.asarray(s, float) ** depth) ** trees


def shortened(threshold: float, target: float) -> tuple[int, int]:
    """(prefix length, trees) that find a link at the threshold with the target's probability: the longest prefix that TREES
    trees suffice for, or one minimum in as many more trees as it takes."""
    if not (0 < threshold <= 1 and 0 < target < 1):
        raise ValueError("threshold and target lie between 0 and 1")
    for x in range(DEPTH, 0, -1):
        if found_share(threshold, x) >= target:
            return x, TREES
    return 1, int(np.ceil(np.log(1 - target) / np.log(1 - threshold)))


def sketched(docs: DataFrame, rid: str, trees: int, text: str, doc_id: str) -> DataFrame:
    """rid, doc_id, hi, lo (hash of the set of shingles, null without words), keys (signatures)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "t"):
            h, n = shingle_hashes([x.as_py() or b"" for x in column(batch, "t")])
            some = np.flatnonzero(n)
            hi, lo, keys = [None] * len(n), [None] * len(n), [None] * len(n)
            if len(some):
                least = (minima(h, n[some], trees * DEPTH) >> np.uint64(32)).astype(">u4")
                for i, s, k in zip(some.tolist(), sets(h, n[some]), least, strict=True):
                    m = mix(s)
                    hi[i], lo[i], keys[i] = int(m.sum().view(np.int64)), int(np.bitwise_xor.reduce(mix(m)).view(np.int64)), k.tobytes()
            yield pa.RecordBatch.from_arrays([column(batch, "rid"), column(batch, "doc_id"), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(keys, pa.binary())], ["rid", "doc_id", "hi", "lo", "keys"])

    rows = docs.select(F.col(rid).alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t"))
    return rows.mapInArrow(run, "rid long, doc_id long, hi long, lo long, keys binary")


def forest(nodes: DataFrame, trees: int) -> DataFrame:
    """tree, key, rep: the leaves of all tries. A key is DEPTH big-endian minima, so its bytes sort as they do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * DEPTH), part.num_rows * trees, [None, pa.py_buffer(b"".join(column(part, "keys").to_pylist()))])
                rep = np.repeat(column(part, "rep").to_numpy(), trees)
                tree = np.tile(np.arange(trees, dtype=np.int32), part.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(tree), keys.cast(pa.binary()), pa.array(rep)], ["tree", "key", "rep"])

    return nodes.select("rep", "keys").mapInArrow(run, "tree int, key binary, rep long")


def trie_links(leaves: DataFrame, depth: int) -> DataFrame:
    """(u, v): each text of a trie node at this depth with one text of it. leaves as from forest(), written to a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None  # (tree, prefix, centre) of the range's first and of its current run
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, rep = column(batch, "tree").to_numpy(), column(batch, "rep").to_numpy()
            minimum = np.frombuffer(b"".join(column(batch, "key").to_pylist()), ">u4").reshape(-1, DEPTH)[:, :depth]
            new = np.append(True, (tree[1:] != tree[:-1]) | (minimum[1:] != minimum[:-1]).any(1))
            if last is not None and last[0] == tree[0] and last[1] == minimum[0].tobytes():
                new[0] = False
            starts = np.flatnonzero(new)
            centre = np.append(last[2] if last else 0, rep[starts])[new.cumsum()]
            if len(starts):
                last = (int(tree[starts[-1]]), minimum[starts[-1]].tobytes(), int(rep[starts[-1]]))
            if first is None:
                first = (int(tree[0]), minimum[0].tobytes(), int(rep[0]))
            own = np.flatnonzero(rep != centre)
            none = pa.nulls(len(own))
            yield pa.RecordBatch.from_arrays([pa.array(rep[own]), pa.array(centre[own]), none.cast(pa.int32()), none.cast(pa.binary())], ["u", "v", "tree", "prefix"])
        for t, p, c in dict.fromkeys(x for x in (first, last) if x):
            yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([c]), pa.array([t], pa.int32()), pa.array([p], pa.binary())], ["u", "v", "tree", "prefix"])

    # The node is part of the order, so that a run of equal signatures is cut between ranges too.
    key = ("tree", "key", "rep")
    ordered = leaves.repartitionByRange(partitions(leaves.sparkSession), *key).sortWithinPartitions(*key)
    found = staged(ordered.mapInArrow(run, "u long, v long, tree int, prefix binary"), "runs")
    ends = found.filter("prefix is not null").select("tree", "prefix", "u")  # two of a range at most
    joined = ends.join(ends.groupBy("tree", "prefix").agg(F.min("u").alias("v")), ["tree", "prefix"]).filter("u <> v")
    return found.filter("prefix is null").select("u", "v").unionByName(joined.select("u", "v"))


def overlaps(found: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairwise intersections of sorted sets, exactly."""
    m = len(found)
    if m == 2:
        return np.array([[0, k := len(np.intersect1d(*found, assume_unique=True))], [k, 0]])
    owner = np.repeat(np.arange(m), [len(s) for s in found])
    flat = np.concatenate(found)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    often = np.diff(np.append(first, len(flat)))
    out = np.zeros((m, m), np.float32)
    for k in range(2, 9):  # shingles in few sets: count their pairs
        at = first[often == k]
        if len(at):
            of = owner[at[:, None] + np.arange(k)]
            a, b = np.triu_indices(k, 1)
            out += np.bincount((of[:, a] * m + of[:, b]).ravel(), minlength=m * m).reshape(m, m).astype(np.float32)
    out += out.T
    many = np.flatnonzero(often > 8)
    for a in range(0, len(many), 2048):  # the others: a product of incidence matrices
        part = many[a : a + 2048]
        table = np.zeros((m, len(part)), np.float32)
        for j, i in enumerate(part.tolist()):
            table[owner[first[i] : first[i] + often[i]], j] = 1
        out += table @ table.T
    return out


def verify(ids: np.ndarray, copies: np.ndarray, side: np.ndarray, across: bool, found: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the texts of a block: links as documents, links as texts, and the least linked text reached.

    across says that two chunks meet, those of side 0 and 1, of which only pairs across count; one of them may have no text.
    """
    size = np.array([len(s) for s in found], float)
    common = overlaps(found)
    linked = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-6
    if across:
        linked &= side[:, None] != side[None, :]
    np.fill_diagonal(linked, False)
    a, b = np.nonzero(np.triu(linked))
    root = ids.copy()
    while True:  # the least id over the links, until nothing moves
        step = root.copy()
        np.minimum.at(step, a, root[b])
        np.minimum.at(step, b, root[a])
        if (step == root).all():
            break
        root = step
    return linked @ copies, linked.sum(1), root


def verified(sets_of: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """root (of the candidates), rep, least, links, text_links of every linked candidate, and whether its block had them all (whole)."""
    spark = sets_of.sparkSession
    sizes = groups.join(sets_of.select("rep", F.octet_length("shingles").alias("b")), F.col("rep") == F.col("node")).groupBy("root").agg(F.count("*").alias("n"), F.sum("b").alias("b"))
    parts = F.greatest(F.ceil(F.col("n") / CHUNK_TEXTS), F.ceil(F.col("b") / CHUNK_BYTES)).cast("int")
    places = join_counted(groups, staged(sizes.select("root", "n", parts.alias("parts")), "set-sizes"), ["root"], "n", groups.count())
    places = places.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # A chunk goes to one block with each chunk of its candidates, itself included.
    dealt = sets_of.join(places, F.col("rep") == F.col("node")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("rep", "root", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"), (F.col("chunk") > F.col("other")).cast("int").alias("side"), "copies", "shingles", "parts")
    # The blocks of one set go to tasks in turn, so that a large set is spread evenly.
    n = partitions(spark)
    turn = F.pmod(F.xxhash64("root"), F.lit(n)) + F.floor(F.col("y") * (F.col("y") + 1) / 2) + F.col("x")
    dealt = dealt.repartitionById(n, F.pmod(turn, F.lit(n)).cast("int")).sortWithinPartitions("root", "x", "y", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def block(root_of: int, x: int, y: int) -> None:
            if len(held) < 2:
                return
            ids, copies, side = (np.array([r[k] for r in held], np.int64) for k in (0, 1, 2))
            links, texts, least = verify(ids, copies, side, x != y, [np.frombuffer(r[3], np.uint64) for r in held], threshold)
            for i in np.flatnonzero(texts).tolist():
                out.append((root_of, int(ids[i]), int(least[i]), int(links[i]), int(texts[i]), held[0][4] == 1))

        def flush() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(_OUT.types)], schema=_OUT)
            out.clear()
            return found

        key = None
        for batch in batches:
            names = ("root", "x", "y", "rep", "copies", "side", "parts")
            rows = zip(*(column(batch, c).to_pylist() for c in names), column(batch, "shingles"), strict=True)
            for root, x, y, rep, n, side, parts, shingles in rows:
                if (root, x, y) != key:
                    if key is not None:
                        block(*key)
                    held.clear()
                    key = (root, x, y)
                    if len(out) > 20_000:
                        yield flush()
                held.append((rep, n, side, shingles.as_py(), parts))
        if key is not None:
            block(*key)
        yield flush()

    return dealt.mapInArrow(run, "root long, rep long, least long, links long, text_links long, whole boolean")


_OUT = pa.schema([("root", pa.int64()), ("rep", pa.int64()), ("least", pa.int64()), ("links", pa.int64()), ("text_links", pa.int64()), ("whole", pa.bool_())])


def _shingles(rows: DataFrame) -> DataFrame:
    """rep, copies, shingles (binary, sorted) of rows with rep, copies, t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "t"):
            h, n = shingle_hashes([x.as_py() or b"" for x in column(batch, "t")])
            yield pa.RecordBatch.from_arrays([column(batch, "rep"), column(batch, "copies"), pa.array([s.tobytes() for s in sets(h, n)], pa.binary())], ["rep", "copies", "shingles"])

    return rows.select("rep", "copies", "t").mapInArrow(run, "rep long, copies long, shingles binary")


def join(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET, text: str = "text", doc_id: str = "doc_id", rid: str | None = None) -> DataFrame:
    """One row per document: rid, doc_id, class_id, links, text_links, depth, recall.

    class_id is the least doc_id that links lead to, links the number of other
    documents of at least that similarity, text_links that of other sets of
    shingles, depth the prefix length matched at, recall the probability with
    which that finds a link at the threshold (more similar ones are surer).
    rid names a column of row numbers, if docs has one.
    """
    depth, trees = shortened(threshold, target)
    if rid is None:
        docs, rid = numbered(docs.select(doc_id, text))
    rows = staged(sketched(docs, rid, trees, text, doc_id), "sketches")
    worded = rows.filter("hi is not null")
    nodes = worded.groupBy("hi", "lo").agg(F.min("rid").alias("rep"), F.min_by("keys", "rid").alias("keys"), F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    nodes = staged(nodes, "nodes")
    leaves = staged(forest(nodes, trees), "forest")
    pairs = staged(trie_links(leaves, depth).distinct(), "trie-links")
    release(leaves)
    wanted = pairs.select(F.col("u").alias("rep")).unionByName(pairs.select(F.col("v").alias("rep"))).distinct()
    wanted = staged(nodes.select("rep", "copies").join(wanted, "rep"), "candidates")
    texts = docs.select(F.col(rid).alias("rep"), F.col(text).cast("binary").alias("t")).join(wanted, "rep").select("rep", "copies", "t")
    sets_of = staged(_shingles(texts), "shingle-sets")

    groups = staged(components(pairs), "candidate-sets")
    links = staged(verified(sets_of, groups, threshold), "links")
    release(sets_of, pairs, wanted)

    per_text = links.groupBy("rep").agg(F.sum("links").alias("links"), F.sum("text_links").alias("text_links"), F.min("least").alias("least"), F.min("root").alias("set"), F.max("whole").alias("whole"))
    per_text = staged(per_text, "linked")
    # In a block with all of its candidates the least text is the class; where chunks met in several, their links are joined up.
    ends = per_text.filter("whole").select("rep", F.col("least").alias("root"))
    if not per_text.filter("not whole").isEmpty():
        several = links.join(per_text.filter("not whole").select("set").distinct(), F.col("root") == F.col("set"), "left_semi")
        joined = components(several.select(F.col("rep").alias("u"), F.col("least").alias("v")))
        ends = ends.unionByName(joined.select(F.col("node").alias("rep"), "root"))
    classes = staged(ends.join(nodes.select("rep", "least"), "rep"), "classes")
    least = staged(classes.groupBy("root").agg(F.min("least").alias("class_id"), F.count("*").alias("n")), "class-ids")
    classes = join_counted(classes.select("rep", "root"), least, ["root"], "n", classes.count()).select("rep", "class_id")
    linked = classes.join(per_text.select("rep", "links", "text_links"), "rep")
    known = nodes.select("rep", "hi", "lo", "copies", "least").join(linked, "rep", "left")
    known = known.select("hi", "lo", "copies", F.coalesce("class_id", "least").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("text_links", F.lit(0)).alias("text_links"))
    out = ("rid", "doc_id", "class_id", F.col("links").cast("long").alias("links"), F.col("text_links").cast("long").alias("text_links"))
    linked = join_counted(worded.select("rid", "doc_id", "hi", "lo"), staged(known, "known"), ["hi", "lo"], "copies", rows.count()).select(*out)
    wordless = rows.filter("hi is null").select("rid", "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).alias("links"), F.lit(0).alias("text_links")).select(*out)
    return linked.unionByName(wordless).withColumn("depth", F.lit(depth)).withColumn("recall", F.lit(float(found_share(threshold, depth, trees))))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs without those whose class has a lesser doc_id (of rows that repeat it, one stays)."""
    rows, rid = numbered(docs)
    some = staged(join(rows, threshold, text=text, doc_id=doc_id, rid=rid).filter("links > 0"), "near-duplicates")
    first = some.filter(F.col("class_id").eqNullSafe(F.col("doc_id"))).groupBy("class_id").agg(F.min("rid").alias("rid"))
    gone = staged(some.select("rid").join(first.select("rid"), "rid", "left_anti").select(F.col("rid").alias(rid)), "dropped")
    return without(rows, rid, gone).select(*docs.columns)
