from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from tracelake.llm import exact_dedup, langid, near_dup, packing, rules
from tracelake.llm.bpe import load_ranks
from tracelake.llm.common import staged
from tracelake.llm.queries import ORACLE_SQL, QUERIES

from .test_methods import brute_links, brute_repeats


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    """The input and output of every stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        result = staged(stage(spark, docs, sf_dir), "test-stage")
        out.append((name, docs, result))
        docs = result
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns(steps):
    for _, docs, result in steps[:-1]:
        assert result.columns == docs.columns == steps[0][1].columns
        before, after = {tuple(r) for r in docs.collect()}, {tuple(r) for r in result.collect()}
        assert after <= before and after


def brute_language(rows):
    """The documents that stay by exact sets of n-grams, for rows (doc_id, text, lang)."""
    rates = {}
    for lang in sorted({x for _, _, x in rows if x}):
        n = Counter(k for _, t, x in rows if x == lang and t is not None for k in langid.grams([t.encode()])[0].tolist())
        rates[lang] = {k: v / sum(n.values()) for k, v in n.items()}
    top = Counter()
    for of in rates.values():
        for k, v in of.items():
            top[k] = max(top[k], v)
    sets = {x: {k for k, v in of.items() if v >= langid.MIN_RATE and v >= langid.SHARE * top[k]} for x, of in rates.items()}
    for_all = set.intersection(*sets.values()) if len(sets) > 1 else set()
    measured = {}
    for i, t, lang in rows:
        keys = langid.grams([(t or "").encode()])[0].tolist()
        hits = sorted(((sum(k in s and k not in for_all for k in keys), x) for x, s in sets.items()), key=lambda h: (-h[0], h[1]))
        if any(c.isalpha() for c in t or ""):
            (own, best), two = hits[0], hits[0][0] + hits[1][0]
            measured[i] = (best == lang, sum(k in sets[best] for k in keys) / len(keys), own / two if two else 0, len(keys), two)
    right = [m for m in measured.values() if m[0] and m[4]]
    low = [sorted(m[k] for m in right)[int(langid.QUANTILE * len(right))] for k in (1, 2)]
    low = langid.SLACK * low[0], 0.5 + langid.SLACK * (low[1] - 0.5)

    def upper(p, n):
        n, z = n / langid.GRAM, langid.WIDTH
        return (p + z * z / (2 * n) + z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n) if n else 1

    return {i for i, (_, known, lead, n, two) in measured.items() if upper(known, n) >= low[0] and upper(lead, two) >= low[1]}


def planted(spark, docs):
    """docs with noise, blobs and texts of two languages, and the ids of these."""
    rng = random.Random(1)
    of = {x: [r.text for r in docs.collect() if r.lang == x and len(r.text) > 1500] for x in ("en", "de")}
    noise = [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randrange(2, 10))) for _ in range(200)) for _ in range(5)]
    blobs = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(900)) for _ in range(5)]
    mixed = [of["en"][k][:1500] + " " + of["de"][k][:1500] for k in range(3)]
    rows = [(10**6 + k, t, None, "s", len(t)) for k, t in enumerate(noise + blobs + mixed)]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    more = spark.createDataFrame(rows, docs.select(*names).schema)
    return docs.select(*names).unionByName(more), {r[0] for r in rows}


def test_language_stage(spark, sf_dir, steps):
    _, docs, result = steps[0]
    assert set(texts(result)) == {i for i, text in texts(docs).items() if any(c.isalpha() for c in text)}
    more, bad = planted(spark, docs)
    more = staged(more, "test-planted")
    left = set(texts(corpus_pipeline.known_language(spark, more, sf_dir)))
    assert not left & bad
    assert left == brute_language([(r.doc_id, r.text, r.lang) for r in more.collect()])
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.quality == 1}
    assert good <= left


def test_language_stage_without_languages(spark, sf_dir):
    """Nothing learned: only texts without a letter go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "if(doc_id = 7, '123 !', text) AS text", "cast(null AS string) AS lang")
    assert corpus_pipeline.known_language(spark, staged(docs, "test-unlabelled"), sf_dir).count() == docs.count() - 1


@pytest.mark.parametrize("k", range(4))
def test_rows_are_those_decided_on(spark, sf_dir, steps, monkeypatch, k):
    """Other splits of the table between a stage's scans change nothing."""
    name, stage = corpus_pipeline.STAGES[k]
    of, what = [(langid, "floors"), (rules, "fit"), (exact_dedup, "dedup"), (near_dup, "join")][k]
    real, sizes = getattr(of, what), {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.leafNodeDefaultParallelism": "16", "spark.sql.files.openCostInBytes": "0"}

    def then_others(*args, **kwargs):
        found = real(*args, **kwargs)
        found = staged(found, "test-found") if k > 1 else found
        for key, value in sizes.items():
            spark.conf.set(key, value)
        return found

    monkeypatch.setattr(of, what, then_others)
    try:
        found = Counter(r.doc_id for r in stage(spark, steps[k][1], sf_dir).collect())
    finally:
        for key in sizes:
            spark.conf.unset(key)
    assert found == Counter(r.doc_id for r in steps[k][2].collect())


def test_rules_stage(spark, sf_dir, steps):
    _, docs, result = steps[1]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    forest, threshold = rules.fit(rules.measured(docs), labels)
    kept = set()
    for i, text in texts(docs).items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        passes = len(words) >= 10 and 100 * brute_repeats(words) <= 20 * len(words)
        if passes and forest.score(np.array([rules.statistics(text.encode())[1]]))[0] < threshold:
            kept.add(i)
    assert set(texts(result)) == kept
    quality = {r.doc_id: r.quality for r in labels.collect()}
    good = [i for i in texts(docs) if quality.get(i) == 1]
    assert sum(i in kept for i in good) >= 0.9 * len(good)


def test_copies_stage(steps):
    _, docs, result = steps[2]
    last = {}
    for i, text in texts(docs).items():
        key = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        last[key] = max(i, last.get(key, i))
    assert set(texts(result)) == set(last.values())


def test_near_copies_stage(steps):
    _, docs, result = steps[3]
    classes = brute_links(list(texts(docs).items()))
    assert set(texts(result)) == {c for _, _, c in classes.values()}


def test_packing_stage(steps):
    _, docs, result = steps[4]
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    rows = result.collect()
    lengths, sequences = Counter(), {}
    for r in rows:
        lengths[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    expected = {i: own.encode_ordinary(t) + [1] for i, t in texts(docs).items()}
    assert lengths == {i: len(ids) for i, ids in expected.items()}
    for r in rows:
        assert zlib.crc32(np.array(expected[r.doc_id][r.start : r.start + r.length], "<u4")) == r.ids_crc32
    for parts in sequences.values():
        assert sum(n for _, n in parts) <= packing.WINDOW


@pytest.mark.parametrize("k", range(5))
def test_stages_on_edge_cases(spark, sf_dir, edge, empty, k):
    name, stage = corpus_pipeline.STAGES[k]
    result = stage(spark, edge, sf_dir)
    ids = Counter(r.doc_id for r in result.select("doc_id").collect())
    if k < 4:
        assert result.columns == edge.columns
    if k == 0:
        assert not {3, 4, 5, 8} & set(ids) and {1, 6, 9, -5, None} <= set(ids)
    if k == 1:
        assert not {3, 4, 5, 9} & set(ids) and {1, 6, 7} <= set(ids)
    if k == 2:
        assert ids[10] == 1 and not {1, 2, -5, 3} & set(ids) and ids[9] == 1 and ids[4] == 1
    if k == 3:
        assert ids[-5] == 1 and not {1, 2, 10, 7} & set(ids) and ids[9] == 1
    assert stage(spark, empty, sf_dir).count() == 0


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_crc(spark):
    from tracelake.llm.common import crc_mod

    rows = spark.createDataFrame([(5,), (-12,), (None,)], "doc_id long").select("doc_id", crc_mod("doc_id", 7).alias("m")).collect()
    assert [r.m for r in rows] == [zlib.crc32(b"5") % 7, zlib.crc32(b"-12") % 7, 0]
