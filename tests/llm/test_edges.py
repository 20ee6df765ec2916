"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns for every operator."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tracelake.llm import bpe, exact_dedup, langid, lbl, near_dup, packing, rules, shards, warc, weak


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_exact_dedup(edge, empty, edge_rows):
    rows = exact_dedup.dedup(edge).collect()
    assert len(rows) == len(edge_rows)
    groups = Counter(hashlib.sha256((r[1] or "").encode().translate(exact_dedup.ASCII_LOWER)).digest() for r in edge_rows)
    assert all(r.group_size == groups[bytes(r.digest)] for r in rows)
    kept = Counter(bytes(r.digest) for r in rows if r.kept)
    assert kept == dict.fromkeys(groups, 1)  # of repeated rows too, one stays
    assert {r.keep_id for r in rows if r.doc_id in (1, 2, 10, -5)} == {10}
    assert {r.keep_id for r in rows if r.doc_id in (3, 4)} == {4}
    assert exact_dedup.dedup(empty).count() == 0
    assert exact_dedup.keep_first_copies(edge).columns == edge.columns


def test_index_persists(spark, edge, tmp_path):
    path = str(tmp_path / "index")
    first = exact_dedup.dedup(edge.filter("doc_id <= 6"), exact_dedup.DigestIndex(spark, path, 4))
    assert first.filter("kept").count() == 4  # the sentence, null and empty, blank, long
    again = exact_dedup.dedup(edge.filter("doc_id > 6"), exact_dedup.DigestIndex(spark, path, 4)).collect()
    assert not any(r.kept for r in again if r.doc_id == 10)
    assert {r.keep_id for r in again if r.doc_id == 10} == {2}
    n = exact_dedup.DigestIndex(spark, path, 4).rows()
    assert n.count() == n.select("digest").distinct().count()


def test_deliveries_in_turn(edge, edge_rows):
    """Cut at any id, larger ids first, the rows are those of one delivery; within each, one row of a digest at most is kept."""
    names = ("doc_id", "keep_id", "group_size", "kept")
    whole = by_id(exact_dedup.dedup(edge), *names)
    for at in (0, 3, 8):
        later = F.coalesce(F.col("doc_id") > at, F.lit(False))
        assert by_id(exact_dedup.dedup_in_turn([edge.filter(later), edge.filter(~later)]), *names) == whole
    twice = exact_dedup.dedup_in_turn([edge, edge]).collect()
    assert sum(r.kept for r in twice) == sum(w[3] for w in whole) and len(twice) == 2 * len(whole)


def test_index_opens_under_other_settings(spark, sf_dir, tmp_path):
    """Written with 8 buckets, opened with 3 shuffle partitions: everything is known; a stated other number is refused."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = str(tmp_path / "index")
    first = exact_dedup.dedup(docs, exact_dedup.DigestIndex(spark, path, 8)).filter("kept").count()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = exact_dedup.DigestIndex(spark, path)
        assert again.buckets == 8
        assert exact_dedup.dedup(docs, again).filter("kept").count() == 0 and again.rows().count() == first
        with pytest.raises(ValueError):
            exact_dedup.DigestIndex(spark, path, 4)
        again.close()
        assert not spark.catalog.tableExists(again.table)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_index_survives_a_death(spark, edge, tmp_path, monkeypatch):
    """A run that dies after its rows are written, or after they count, gives the same result when it runs again."""
    path, names = str(tmp_path / "index"), ("doc_id", "keep_id", "group_size", "kept")
    whole = by_id(exact_dedup.dedup(edge), *names)
    real = exact_dedup.DigestIndex._publish

    def dies(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(exact_dedup.DigestIndex, "_publish", dies)
    with pytest.raises(RuntimeError):
        exact_dedup.dedup(edge, exact_dedup.DigestIndex(spark, path), batch="day 1")
    monkeypatch.setattr(exact_dedup.DigestIndex, "_publish", real)
    index = exact_dedup.DigestIndex(spark, path)
    assert index.rows().count() == 0
    for _ in range(2):
        assert by_id(exact_dedup.dedup(edge, index, batch="day 1"), *names) == whole
    assert not any(r.kept for r in exact_dedup.dedup(edge, index, batch="day 2").collect())
    assert index.rows().count() == index.rows().select("digest").distinct().count()


def test_bpe(edge, empty, edge_rows):
    found = bpe.encode_documents(edge, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, ids=True)
    assert found.count() == len(edge_rows)
    for r in found.collect():
        assert r.n_tokens == len(r.ids)
    back = bpe.decode_documents(found, P.path("byte_bpe_50k.tiktoken"))
    assert by_id(back, "doc_id", "text") == sorted(((r[0], r[1] or "") for r in edge_rows), key=repr)
    assert bpe.encode_documents(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_packing(edge, empty, edge_rows):
    found = packing.pack_documents(edge, P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    assert sum(r.length for r in found if r.doc_id == 3) == 1 and sum(r.length for r in found if r.doc_id == 4) == 1
    assert sum(1 for r in found if r.doc_id == 9 and r.start == 0) == 2
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    assert packing.pack_documents(empty, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def test_shards(edge, empty, edge_rows):
    rows = shards.assign(edge, 4).collect()
    assert len(rows) == len(edge_rows)
    texts = {r[0]: r[1] for r in edge_rows}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    assert len({r.shard for r in rows if r.doc_id in (1, 10, -5)}) == 1
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert shards.assign(empty, 4).count() == 0


def test_language(edge, empty):
    known = langid.learn(edge)
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(edge, known).collect()}
    assert found[3] == found[4] == found[5] == found[8] == ("und", 0.0)
    assert found[1][0] == "en" and 0 <= found[1][1] <= 1
    assert found[12][0] == "en"
    nothing = langid.learn(empty)
    assert nothing.languages == []
    assert {r.lang_pred for r in langid.identify(edge, nothing).collect()} == {"und"}
    assert langid.identify(empty, known).count() == 0


def test_rules(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 0), (None, 0, 1), (6, None, 0), (10, 1, 0), (10, 0, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in rules.judge(edge, labels).collect()}
    assert found[3].base_failed and found[4].n_words == 0 and found[5].base_failed and found[9].base_failed
    assert found[1].kept and found[6].kept
    assert found[6].n_words == 30_000
    assert rules.judge(empty, labels).count() == 0
    assert rules.judge(edge, labels.limit(0)).filter("kept = base_failed").count() == 0


def test_weak(edge, empty, edge_rows):
    found = {r.doc_id: r for r in weak.classify(edge).collect()}
    assert len(found) == len({r[0] for r in edge_rows})
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in found.values())
    assert weak.classify(empty).count() == 0


def test_scores(edge, empty, edge_rows):
    counts, words, model = lbl.fit(edge)
    found = lbl.score(edge, counts, words, model, extra={"doc_id": F.col("doc_id"), "source": F.col("source")})
    rows = found.collect()
    assert len(rows) == len(edge_rows)
    at = {r.doc_id: r for r in rows}
    assert at[3].n_tokens == at[4].n_tokens == at[5].n_tokens == 1 and at[3].score == pytest.approx(at[4].score)
    assert at[6].n_tokens == 30_001 and at[6].n_known == 30_001
    assert all(r.score <= 0 and r.base_score <= 0 for r in rows)
    assert lbl.score(empty, counts, words, model).count() == 0
    counts, words, model = lbl.fit(empty)
    assert {r.n_known for r in lbl.score(edge, counts, words, model).collect()} == {0}


def test_near(edge, empty, edge_rows):
    rows = near_dup.join(edge).collect()
    assert len(rows) == len(edge_rows)
    at = {}
    for r in rows:
        at.setdefault(r.doc_id, []).append(r)
    assert {r.class_id for i in (1, 2, 10, -5) for r in at[i]} == {-5}
    assert all(r.links == 3 for i in (1, 2, 10, -5) for r in at[i])
    assert {r.class_id for i in (6, 7) for r in at[i]} == {6} and at[6][0].text_links == 1
    assert [r.links for i in (3, 4, 5) for r in at[i]] == [0, 0, 0]
    assert len(at[9]) == 2 and all(r.links == 1 for r in at[9])
    left = near_dup.keep_one(edge)
    assert left.columns == edge.columns
    assert Counter(r.doc_id for r in left.collect()) == {-5: 1, 3: 1, 4: 1, 5: 1, 6: 1, 8: 1, 9: 1, 11: 1, 12: 1, None: 1}
    assert near_dup.join(empty).count() == 0


@pytest.mark.parametrize("limit", [0, 1 << 19])
def test_warc_by_either_join(spark, tmp_path, monkeypatch, limit):
    """Many repeated payloads meet their pages in a merge join, the hot ones apart."""
    monkeypatch.setattr(warc, "BROADCAST", limit)
    rows = [(i, "u", "h" * 1500) for i in range(1500)] + [(2000 + i, "u", f"{i % 40:04}" * 400) for i in range(120)] + [(9000, "u", "alone" * 500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    found = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(pages, str(tmp_path / "w")).collect()}
    last = {}
    for i, _, html in rows:
        last[html] = max(i, last.get(html, -1))
    assert found == {i: ("response", None) if last[html] == i else ("revisit", last[html]) for i, _, html in rows}


@pytest.mark.parametrize("limit", [0, 1 << 19])
def test_copies_by_either_join(edge, monkeypatch, limit):
    from tracelake.llm import common

    monkeypatch.setattr(common, "BROADCAST", limit)
    assert Counter(r.doc_id for r in exact_dedup.keep_first_copies(edge).collect()) == {10: 1, 4: 1, 5: 1, None: 1, 6: 1, 7: 1, 8: 1, 9: 1, 11: 1, 12: 1}


def test_bpe_without_the_space_rule(edge):
    path = P.path("byte_bpe_50k.tiktoken")
    assert by_id(bpe.encode_documents(edge, path, P.PATTERN, at_spaces=False), "doc_id", "n_tokens", "ids_sha256") == by_id(bpe.encode_documents(edge, path, P.PATTERN), "doc_id", "n_tokens", "ids_sha256")


def test_warc(spark, tmp_path):
    big = "x" * 1500
    rows = [(1, "u1", big, 9), (2, None, big, 9), (3, "u 3\r\nInjected: y", "small", 9), (4, "u", "small", 9), (5, "u", None, 9), (6, "u", "", 9), (None, "u", big, 9), (7, "u", "é" * 700, 9), (2, "u", big, 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest long")
    found = warc.round_trip(pages, str(tmp_path / "w")).collect()
    assert len(found) == len(rows)
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in found)
    assert kinds == [(0, "revisit", 2), (1, "revisit", 2), (2, "response", None), (2, "response", None), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None)]
    assert {r.payload_bytes for r in found if r.page_id in (5, 6)} == {0} and {r.payload_bytes for r in found if r.page_id in (1, 7)} == {1500, 1400}
    assert {r.payload_digest for r in found if r.page_id == 1} == {hashlib.sha1(big.encode()).hexdigest()}
    index = spark.read.parquet(str(tmp_path / "w/index"))
    one = warc.read_archives(index.filter("page_id = 7"), payloads=True).collect()
    assert [bytes(r.payload).decode() for r in one] == ["é" * 700]
    assert warc.round_trip(pages.limit(0), str(tmp_path / "e")).count() == 0
