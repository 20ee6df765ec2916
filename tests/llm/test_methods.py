"""The methods against brute force, exact round trips and held-out rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracelake.llm import bpe, langid, lbl, near_dup, packing, rules, shards, shingles, weak
from tracelake.llm.common import staged


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def prefix_bpe(ranks):
    return bpe.PrefixBPE(ranks, P.PATTERN)


@pytest.fixture(scope="module")
def reference_bpe(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


LETTERS = "ab eE.'\n\t  !1é中\xa0sdtlrv日🙂\0<|>-_"


def test_bpe_is_the_tokenizer(prefix_bpe, reference_bpe):
    rng = random.Random(3)
    for _ in range(1500):
        x = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(60)))
        assert prefix_bpe.encode(x) == reference_bpe.encode_ordinary(x), x
        assert "".join(bpe.words(x)) == x
        assert [t for w in bpe.words(x) for t in prefix_bpe.encode(w)] == reference_bpe.encode_ordinary(x), x
        assert prefix_bpe.decode(prefix_bpe.encode(x)).decode() == x
    x = "x" * 5000 + " 語" * 500 + "ab" * 700
    assert prefix_bpe.encode(x) == reference_bpe.encode_ordinary(x)


def test_bpe_edits(prefix_bpe, reference_bpe):
    rng = random.Random(4)
    for _ in range(400):
        e = bpe.Encoded(prefix_bpe, "".join(rng.choice(LETTERS) for _ in range(rng.randrange(40))))
        for _ in range(4):
            new = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(6)))
            i = rng.randrange(len(e.text) + 1)
            e.edit(i, min(len(e.text), i + rng.randrange(5)), new)
            assert e.ids == reference_bpe.encode_ordinary(e.text)
            e.append(new)
            assert e.ids == reference_bpe.encode_ordinary(e.text)
    e = bpe.Encoded(prefix_bpe, "some words in a row " * 500)
    before = e.fresh
    e.edit(100, 105, "other")
    assert e.fresh - before < 12  # only near the edit


def test_prefix_table_reads_every_prefix(prefix_bpe, reference_bpe):
    piece = b"unbelievablythings"
    table = prefix_bpe.extend(piece, [])
    for j in range(1, len(piece) + 1):
        assert prefix_bpe.read(table, j) == reference_bpe.encode_ordinary(piece[:j].decode())


def test_packing_tokenizer():
    own, ref = packing.tokenizer(P.path("byte_bpe_50k.json"), P.PATTERN), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ref.encode_special_tokens = True
    for x in ("", "a  b\n c", "<|endoftext|> x", "日本 \x00", "It's we're 12 !!"):
        assert own(x) == ref.encode(x, add_special_tokens=False).ids


def test_packing_added_tokens(spark):
    path = P.path("byte_bpe_50k.json")
    ref = Tokenizer.from_file(path)
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n b", "<|endoftext", "日本 <|endoftext|>é", "plain  text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in packing.pieces(docs, path, P.PATTERN).collect()}
    ids = [np.array([*ref.encode(x, add_special_tokens=False).ids, 1], "<u4") for x in texts]
    assert ids[0].tolist() == [31373, 220, 50256, 995, 1]
    assert found == {i: (len(x), zlib.crc32(x)) for i, x in enumerate(ids)}


@given(st.lists(st.integers(1, 2047), max_size=60))
@settings(max_examples=60, deadline=None)
def test_karmarkar_karp(sizes):
    groups = packing.pack(sizes)
    assert sorted(i for g in groups for i in g) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in g) <= packing.WINDOW for g in groups)


def test_tiny_pieces_are_bundled():
    """A batch of pieces of one id packs as tightly, in a bounded number of items."""
    rng = np.random.default_rng(3)
    sizes = np.concatenate([np.ones(60_000, int), rng.integers(1, 512, 200)]).tolist()
    bundles = packing.bundled(sizes)
    assert sorted(i for b in bundles for i in b) == list(range(len(sizes))) and len(bundles) < 60_000 // 60
    groups = packing.pack(sizes)
    assert sorted(i for g in groups for i in g) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in g) <= packing.WINDOW for g in groups) and len(groups) <= -(-sum(sizes) // packing.WINDOW) + 1


def test_differencing_balances():
    rng = np.random.default_rng(0)
    sizes = rng.integers(100, 512, 400).tolist()
    sums = [sum(sizes[i] for i in g) for g in packing.karmarkar_karp(sizes, 60)]
    assert max(sums) - min(sums) < 60
    assert sum(sizes) / (packing.WINDOW * len(packing.pack(sizes))) > 0.95


@given(st.integers(1, 20_000))
@settings(max_examples=100, deadline=None)
def test_cuts_cover(n):
    at = 0
    for start, length in packing.cuts(n):
        assert start == at and 0 < length <= packing.WINDOW
        at += length
    assert at == n


@given(st.lists(st.integers(1, 50), min_size=1, max_size=24), st.integers(1, 7))
@settings(max_examples=150, deadline=None)
def test_capacity_is_minimal(sizes, k):
    ends = np.cumsum(sizes)

    @cache
    def best(i, left):
        if i == len(sizes):
            return 0
        return 10**9 if not left else min(max(sum(sizes[i:j]), best(j, left - 1)) for j in range(i + 1, len(sizes) + 1))

    found = shards.smallest_capacity(ends, k, -(-int(ends[-1]) // k), int(ends[-1]))
    assert found == best(0, k)
    cuts = shards.cut(ends, found, k)
    edges = [0, *cuts]
    assert len(cuts) == k and cuts[-1] == len(sizes)
    assert max(sum(sizes[a:b]) for a, b in zip(edges, edges[1:], strict=False)) == found


@pytest.mark.parametrize("fetch", [1 << 16, 4, 0])
def test_plan_is_that_of_all_groups(spark, monkeypatch, fetch):
    """However far ranges are split before groups are fetched."""
    monkeypatch.setattr(shards, "BINS", 1 << 6)
    rng = np.random.default_rng(5)
    rows = [(int(h), int(s)) for h, s in zip(rng.integers(-(2**63), 2**63 - 1, 3000), rng.integers(1, 2000, 3000), strict=True)]
    rows.append((77, 2_000_000))  # a hot group
    rows += [(x, 1500) for x in range(10**15, 10**15 + 300)]  # neighbours that many splits leave together
    hot, starts, first = shards.plan(spark.createDataFrame(rows, "h long, size long"), 16, fetch)
    total = sum(s for _, s in rows)
    big = sorted(h for h, s in rows if s > total // shards.HOT)
    order = [(h, s) for h, s in sorted(rows) if h in set(big)] + [(h, s) for h, s in sorted(rows) if h not in set(big)]
    ends = np.cumsum([s for _, s in order])
    capacity = shards.smallest_capacity(ends, 16, -(-total // 16), total)
    assert dict(hot).keys() == set(big)
    sums = Counter()
    for h, s in rows:
        shard = dict(hot).get(h, first + sum(h >= x for x in starts))
        sums[shard] += s
    assert max(sums.values()) == capacity and max(sums) <= 15


def brute_repeats(words):
    n = len(words)
    seen = Counter(tuple(words[i : i + 5]) for i in range(n - 4))
    return len({j for i in range(n - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)})


def test_rule_counts():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["a ", "b ", "c\n", "# ", "é\t", "dd  ", "\n", "a b c d e "]) for _ in range(rng.randrange(40)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        expected = [len(words), sum(map(len, words)), sum(text.count(c) for c in rules.SYMBOLS), dup, brute_repeats(words)]
        if not words:
            expected = [0] * 5
        assert rules.statistics(text.encode())[0] == expected, text
    many = np.arange(20_000) % 9000
    assert rules.repeat_words(many, 9000) == 20_000


def test_rule_features():
    """The forest's features by plain counting."""
    rng = random.Random(12)
    marks = "!?;:#*$%&|<>+=/\\~^_@"
    for _ in range(200):
        text = "".join(rng.choice(["ab ", "AB ", "é! ", "# ", "word\n", "A\t", "x x ", "\n", "12 ", "A1;\n", "a b c d e "]) for _ in range(rng.randrange(1, 40)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        found = rules.statistics(text.encode())[1]
        if not words:
            assert found == [0.0] * len(rules.FEATURES)
            continue
        n, lines = len(words), [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expected = [
            min(4, sum(text.count(c) for c in rules.SYMBOLS) / n), sum(w[-1] in marks for w in words) / n, sum(len(w) == 1 and 33 <= ord(w) < 127 and not w.isalnum() for w in words) / n,
            sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, sum(len(w.encode()) > 1 and w.encode().isupper() for w in words) / n, min(rules.LONG, sum(map(len, words)) / n),
            (len(lines) - len(set(lines))) / len(lines), brute_repeats(words) / n,
        ]
        assert found == pytest.approx(expected), text


def test_forest_finds_what_lies_apart():
    rng = np.random.default_rng(0)
    good = np.abs(rng.normal(0, 0.02, (500, 5)))
    bad = np.zeros((40, 5))
    bad[np.arange(40), np.arange(40) % 5] = 0.6
    forest = rules.grow(good, rules.BOX)
    score, is_bad = forest.score(np.concatenate([good, bad])), np.arange(540) >= 500
    threshold = rules.calibrate(score, is_bad)
    assert (score[is_bad] >= threshold).mean() > 0.95 and (score[~is_bad] >= threshold).mean() < 0.01
    assert rules.calibrate(np.ones(4), np.zeros(4, bool)) == float("inf")


def test_forest_sees_the_counts():
    """Repeated lines and very long words lie apart from prose; capitals are counted exactly."""
    rng = random.Random(7)
    words = [f"{''.join(rng.choice('abcdeilnorst') for _ in range(rng.randrange(2, 9)))}" for _ in range(3000)]
    line = lambda: " ".join(rng.choice(words) for _ in range(9)) + "."
    good = ["\n".join(line() for _ in range(12)) for _ in range(300)]
    echo = ["\n".join(x for _ in range(12) for x in (line(), "read more")) for _ in range(20)]
    blobs = ["\n".join(" ".join("".join(rng.choice("abcdef") for _ in range(60)) for _ in range(9)) for _ in range(12)) for _ in range(20)]
    x = np.array([rules.statistics(t.encode())[1] for t in good + echo + blobs])
    assert x.shape[1] == len(rules.FEATURES)
    is_bad = np.arange(340) >= 300
    score = rules.grow(x[~is_bad], rules.FULL_BOX).score(x)
    threshold = rules.calibrate(score, is_bad)
    assert (score[is_bad] >= threshold).mean() > 0.95 and (score[~is_bad] >= threshold).mean() < 0.01
    assert rules.statistics(b"AB cd ef gh ij kl mn op")[1][rules.FEATURES.index("caps_share")] == 1 / 8


def test_forest_and_threshold_come_from_all_labelled_rows(spark):
    """The one row in 16 that a sample of 20,000 by hash leaves out of 21,400 counts too: the bad rows here are all of those."""
    n = 21_400
    ids = spark.range(n).select(F.col("id").alias("doc_id"))
    left_out = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) >= int((1 << 20) * 20_000 / n)
    features = F.array(*[F.when(left_out, 0.9 - k / 100).otherwise(F.col("doc_id") % (50 + k) / 5000.0) for k in range(8)])
    rows = ids.select("doc_id", F.lit(100).alias("n_words"), F.lit(0).alias("n_repeat_words"), features.alias("features"))
    labels = ids.select("doc_id", F.when(left_out, 0).otherwise(1).alias("quality"))
    forest, threshold = rules.fit(rows, labels)
    found = rows.select("features", left_out.alias("bad")).collect()
    x, bad = np.array([r.features for r in found]), np.array([r.bad for r in found])
    assert bad.any() and threshold < 1
    whole = rules.grow(x[~bad], rules.FULL_BOX)
    for name in ("feature", "cut", "low", "high", "roots"):
        assert (getattr(forest, name) == getattr(whole, name)).all(), name
    assert threshold == rules.calibrate(whole.score(x), bad)
    assert (whole.score(x[bad]) >= threshold).all() and (whole.score(x[~bad]) < threshold).all()


def test_threshold_by_ranges(spark):
    """The threshold of a table is that of all its rows, with ties and whatever the ranges are."""
    rng = np.random.default_rng(4)
    for k in range(4):
        score, bad = rng.integers(1, 60, 400) / 64, rng.random(400) < 0.3
        score[bad] += k / 5
        table = spark.createDataFrame([(float(s), bool(b)) for s, b in zip(score, bad, strict=True)], "score double, bad boolean")
        for weight in (0.5, 20.0):
            assert rules.calibrated(table, weight) == rules.calibrate(score, bad, weight)
        assert rules.calibrated(table.filter("bad")) == float("inf")


def test_labelled_quality(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    quality = {r.doc_id: r.quality for r in labels.collect()}
    for found in (rules.judge(docs, labels), weak.classify(docs)):
        rows = [(r.kept, quality[r.doc_id]) for r in found.collect() if r.doc_id in quality]
        bad, good = [k for k, q in rows if q == 0], [k for k, q in rows if q == 1]
        assert sum(bad) <= 0.15 * len(bad) and sum(good) >= 0.85 * len(good)


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    train = docs.filter("doc_id % 3 <> 0")
    found = {r.doc_id: r.lang_pred for r in langid.identify(docs, langid.learn(train)).collect()}
    held = [r for r in rows if r.doc_id % 3 == 0 and r.lang]
    assert sum(found[r.doc_id] == r.lang for r in held) >= 0.95 * len(held)


def test_language_against_exact_sets(spark, sf_dir):
    """Popcounts corrected for false positives are near those of exact sets, and so are choice and score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [r for r in docs.collect() if r.text]
    train = [r for r in rows if r.doc_id % 3]
    rates = {}
    for lang in sorted({r.lang for r in train if r.lang}):
        n = Counter(k for r in train if r.lang == lang for k in langid.grams([r.text.encode()])[0].tolist())
        rates[lang] = {k: v / sum(n.values()) for k, v in n.items()}
    top = {k: max(of.get(k, 0) for of in rates.values()) for of in rates.values() for k in of}
    sets = [{k for k, v in of.items() if v >= langid.MIN_RATE and v >= langid.SHARE * top[k]} for of in rates.values()]
    for_all = set.intersection(*sets)
    known = langid.learn(docs.filter("doc_id % 3 <> 0"))
    assert known.languages == list(rates)
    tell, every, total = known.counts([r.text.encode() for r in rows])
    found = {r.doc_id: r for r in langid.identify(docs, known).collect()}
    same = 0
    for i, r in enumerate(rows):
        keys = langid.grams([r.text.encode()])[0].tolist()
        exact = np.array([sum(k in s and k not in for_all for k in keys) for s in sets], float)
        assert total[i] == len(keys)
        assert np.abs(tell[i] - exact).max() <= 0.03 * len(keys) + 3
        assert np.abs(every[i] - [sum(k in s for k in keys) for s in sets]).max() <= 0.03 * len(keys) + 3
        if any(c.isalpha() for c in r.text) and exact.sum() > 20:
            same += found[r.doc_id].lang_pred == list(rates)[int(exact.argmax())]
            assert abs(found[r.doc_id].score - exact.max() / exact.sum()) < 0.08
        else:
            same += 1
    assert same >= len(rows) - 1


def test_bitmask_filter_has_no_false_negatives():
    rng = np.random.default_rng(1)
    key, lang = rng.integers(0, 2**32, 4000).astype(np.uint32), rng.integers(0, 70, 4000)
    known = langid.build([f"l{i:02d}" for i in range(70)], key, lang)
    at = langid.slots(key, len(known.masks))
    for k in range(70):
        own = lang == k
        mask = known.masks[at[0][own], k // 64]
        for more in at[1:]:
            mask = mask & known.masks[more[own], k // 64]
        assert ((mask >> np.uint64(k % 64)) & np.uint64(1)).all()


def test_variety_reads_all_words():
    at = weak.HEURISTICS.index("variety")
    rng = random.Random(6)
    vote = lambda words: weak.votes(" ".join(words).encode())[at]
    assert vote([f"w{i}" for i in range(401)] * 50) == -1
    assert vote([f"w{i}" for i in range(400)] + ["w0"] * 19_600) == -1
    natural = [f"w{int(rng.paretovariate(0.15))}" for _ in range(20_000)]
    assert vote(natural) == vote(natural[:400]) == 1
    some = [f"w{rng.randrange(300)}" for _ in range(800)]
    assert abs(weak.variety([w.encode() for w in some[:799]]) - weak.variety([w.encode() for w in some])) < 0.01


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.8
    accuracy = np.array([0.95, 0.9, 0.8, 0.7, 0.85])
    right = rng.random((20_000, 5)) < accuracy
    votes = np.where(right == y[:, None], 1, -1) * (rng.random((20_000, 5)) < 0.7)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = weak.estimate(patterns, counts.astype(float))
    assert abs(model.good - 0.8) < 0.03
    found = model.rates[1, :, 2] / (model.rates[1, :, 2] + model.rates[1, :, 0])
    assert np.abs(found - accuracy).max() < 0.04
    assert ((model.posterior(patterns)[inverse.ravel()] > 0.5) == y).mean() > 0.93


def test_label_model_against_brute_force():
    """The posterior by products of probabilities, and EM that never lowers the likelihood of the votes."""
    rng = np.random.default_rng(4)
    patterns = np.unique(rng.integers(-1, 2, (60, 4)), axis=0)
    counts = rng.integers(1, 50, len(patterns)).astype(float)
    model = weak.estimate(patterns, counts, 5)
    for row, p in zip(patterns, model.posterior(patterns), strict=True):
        good, bad = model.good, 1 - model.good
        for h, v in enumerate(row):
            bad, good = bad * model.rates[0, h, v + 1], good * model.rates[1, h, v + 1]
        assert p == pytest.approx(good / (good + bad))

    def likelihood(m):
        each = [sum((1 - m.good, m.good)[c] * np.prod([m.rates[c, h, v + 1] for h, v in enumerate(row)]) for c in (0, 1)) for row in patterns]
        smooth = 0.5 * np.log(m.rates).sum()  # the half a count that each rate starts from
        return float((counts * np.log(each)).sum() + smooth)

    course = [likelihood(weak.estimate(patterns, counts, k)) for k in (1, 2, 4, 8, 32)]
    assert all(b >= a - 1e-6 for a, b in zip(course, course[1:], strict=False))


def test_scorer_against_brute_force(spark, sf_dir):
    """Every document's votes, posterior and score by plain loops, from the patterns of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    votes = {r.doc_id: weak.votes((r.text or "").encode()) for r in rows}
    counted = Counter(tuple(v) for v in votes.values())
    patterns = sorted(counted)
    model = weak.estimate(np.array(patterns), np.array([counted[p] for p in patterns], float))
    posterior = dict(zip(patterns, model.posterior(np.array(patterns)), strict=True))

    def features(text, of_votes):
        data = text.encode().translate(weak.ASCII_LOWER)
        places = weak.BUCKETS - 3 * len(weak.HEURISTICS)
        n = Counter((((data[i] | data[i + 1] << 8 | data[i + 2] << 16) * 2654435761 % 2**32) >> 8) % places for i in range(len(data) - 2))
        x = np.zeros(weak.BUCKETS, np.float32)
        for k, c in n.items():
            x[k] = (c / (len(data) - 2)) ** 0.5
        for h, v in enumerate(of_votes):
            x[places + 3 * h + 1 + v] = 0.3
        return x

    found = {r.doc_id: r for r in weak.classify(docs).collect()}
    x = {r.doc_id: features(r.text or "", votes[r.doc_id]) for r in rows}
    order = [r.doc_id for r in sorted(weak.classify(docs).select("rid", "doc_id").collect(), key=lambda r: r.rid)]
    assert len(rows) <= weak.MAX_TRAIN  # so all rows train
    w = weak.train(np.stack([x[i].astype("<f2").astype(np.float32) for i in order]), np.array([posterior[tuple(votes[i])] for i in order]))
    for r in rows:
        assert found[r.doc_id].posterior == pytest.approx(posterior[tuple(votes[r.doc_id])], abs=1e-9)
        assert found[r.doc_id].score == pytest.approx(1 / (1 + np.exp(-(float(x[r.doc_id] @ w[:-1]) + w[-1]))), abs=1e-3)


def test_hashing_in_steps(monkeypatch):
    text = [b"some words of a text that is cut", b"ab", b""]
    of_votes = np.zeros((3, len(weak.HEURISTICS)), int)
    whole = weak.hashed(text, of_votes)
    monkeypatch.setattr(weak, "STEP_BYTES", 5)
    assert np.allclose(weak.hashed(text, of_votes), whole)


def some_model(seed=0):
    rng = np.random.default_rng(seed)
    there = np.arange(lbl.SLOTS) < rng.integers(1, lbl.SLOTS + 1, lbl.CLASSES)[:, None]
    share = np.where(there.ravel(), rng.random(lbl.WORDS), 0)
    model = lbl.Model.start(share / share.sum(), seed)
    model.classes += rng.normal(0, 1, model.classes.shape).astype(np.float32)
    model.members += rng.normal(0, 1, model.members.shape).astype(np.float32)
    return model, share / share.sum()


def dense_log_prob(model, before, word):
    """log10 P(word | words before, the nearest first) by loops over plain numbers."""
    q = [sum(float(model.inp[before[j]][d]) * float(model.scale[j][d]) for j in range(lbl.CONTEXT)) for d in range(lbl.WIDTH)]
    dot = lambda v, b: sum(x * float(y) for x, y in zip(q, v, strict=True)) + float(b)
    classes = [np.exp(dot(model.classes[k], model.class_bias[k])) for k in range(lbl.CLASSES)]
    k = word // lbl.SLOTS
    members = [np.exp(dot(model.members[i], model.member_bias[i])) for i in range(k * lbl.SLOTS, (k + 1) * lbl.SLOTS)]
    return np.log10(classes[k] / sum(classes)) + np.log10(members[word % lbl.SLOTS] / sum(members))


def test_model_against_dense_evaluation():
    model, share = some_model()
    rng = np.random.default_rng(1)
    rows = [rng.choice(lbl.WORDS, n, p=share).astype(np.uint16) for n in (1, 2, 7, 40)]
    flat, at = lbl.framed(rows)
    found = model.log_probs(flat, at)
    expected = [dense_log_prob(model, [r[i - 1 - j] if i > j else lbl.WORDS for j in range(lbl.CONTEXT)], int(r[i])) for r in rows for i in range(len(r))]
    assert found == pytest.approx(expected, rel=1e-4)


def test_model_is_normalised():
    model, share = some_model(3)
    flat = np.concatenate([x for w in range(lbl.WORDS) for x in ([5, 9, 300, 4000], [w])]).astype(np.uint16)
    p = 10 ** model.log_probs(flat, np.arange(4, len(flat), 5))
    assert p.sum() == pytest.approx(1, abs=1e-4) and p[share == 0].sum() < 1e-6


def test_training_shards(spark, sf_dir, monkeypatch, tmp_path):
    """The same rows in other files give the same scores; more shards lose little."""
    larger = Path(sf_dir).parent / "sf0.01"
    docs = spark.read.parquet(f"{larger if larger.exists() else sf_dir}/documents.parquet").select("doc_id", "text")
    docs = staged(docs.unionByName(docs.limit(20)), "test-docs")  # rows that repeat

    def scores(shards, files):
        monkeypatch.setattr(lbl, "SHARD_TOKENS", shards)
        path = str(tmp_path / f"d{shards}-{files}")
        docs.repartition(files).write.mode("overwrite").parquet(path)
        found = lbl.fit_and_score(spark.read.parquet(path), F.col("doc_id") % 4 != 0, extra={"doc_id": F.col("doc_id")}, key="doc_id").collect()
        return sorted((r.doc_id, r.score, r.base_score, r.n_tokens) for r in found)

    short = 40 * lbl.STEP  # tokens of a shard
    a, b, c = scores(short, 1), scores(short, 8), scores(1 << 30, 3)
    assert [x[0] for x in a] == [x[0] for x in b]
    assert [x[1] for x in a] == pytest.approx([x[1] for x in b], rel=1e-6)
    gain = lambda rows: sum(x[1] - x[2] for x in rows if x[0] % 4 == 0) / sum(x[3] for x in rows if x[0] % 4 == 0)
    assert gain(a) > 0.4 * gain(c) > 0.01


def test_long_texts_in_steps(monkeypatch):
    """Rules, votes and language counts of a text don't depend on the steps in which it is read."""
    rng = random.Random(10)
    texts = ["".join(rng.choice(["ab ", "a b c d e ", "é! ", "word\n", "AB CD ", "\t\n", "x", "日本 "]) for _ in range(rng.randrange(1, 200))).encode() for _ in range(60)]
    texts += [b" " * 50, b"x" * 50, b"a"]
    known = langid.build(["de", "en"], np.unique(langid.grams(texts[:20])[0]), np.arange(len(np.unique(langid.grams(texts[:20])[0]))) % 2)
    whole = [(rules.statistics(t), weak.votes(t)) for t in texts]
    counted, keys = known.counts(texts), langid.grams(texts)
    for module in (rules, langid, "tracelake.llm.common"):
        monkeypatch.setattr(*((f"{module}.STEP_BYTES", 16) if isinstance(module, str) else (module, "STEP_BYTES", 16)))
    for t, (of_rules, of_votes) in zip(texts, whole, strict=True):
        found = rules.statistics(t)
        assert found[0] == of_rules[0] and found[1] == pytest.approx(of_rules[1]) and weak.votes(t) == of_votes
    assert all((a == b).all() for a, b in zip(langid.grams(texts), keys, strict=True))
    assert all(np.allclose(a, b) for a, b in zip(known.counts(texts), counted, strict=True))


def test_variety_by_windows():
    rng = random.Random(13)
    for n in (1, 399, 400, 401, 800, 801, 1234):
        words = [f"w{rng.randrange(500)}" for _ in range(n)]
        starts = [*range(0, n - weak.SPAN, weak.SPAN), n - weak.SPAN] if n > weak.SPAN else [0]
        mean = sum(len(set(words[a : a + weak.SPAN])) / min(n, weak.SPAN) for a in starts) / len(starts)
        assert weak.variety(words) == pytest.approx(min(mean, len(set(words)) / (n * weak.SPAN) ** 0.5) if n > weak.SPAN else mean)


def test_spans_are_tokens(monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(lbl, "SPAN", 7)
    assert [w for part in lbl.spans(None) for w in part] == lbl.tokens(None)
    for _ in range(300):
        text = "".join(rng.choice("aB é\n\t  longword") for _ in range(rng.randrange(60))).encode()
        assert [w for part in lbl.spans(text) for w in part] == lbl.tokens(text)


def test_scores_against_counting(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    train = docs.filter("doc_id % 4 <> 0")
    counts, words, model = lbl.fit(train)
    found = {r.doc_id: r for r in lbl.score(docs, counts, words, model, extra={"doc_id": F.col("doc_id")}).collect()}
    c = Counter(t for r in rows if r.doc_id % 4 for t in lbl.tokens(r.text.encode()))
    n, v = sum(c.values()), len(c)
    better = total = 0
    for r in rows:
        own = lbl.tokens(r.text.encode())
        assert found[r.doc_id].base_score == pytest.approx(sum(np.log10((c[t] + 1) / (n + v + 1)) for t in own), rel=1e-9)
        assert (found[r.doc_id].n_known, found[r.doc_id].train_tokens) == (sum(c[t] > 0 for t in own), n)
        if r.doc_id % 4 == 0:
            better, total = better + found[r.doc_id].score - found[r.doc_id].base_score, total + 1
    assert better > 0 and total > 10
    # A small head sends most words through the join, and must change nothing.
    small = lbl.vocabulary(counts, 300)
    same = lbl.score(docs, counts, small, model, extra={"doc_id": F.col("doc_id")}).collect()
    assert all(r.base_score == pytest.approx(found[r.doc_id].base_score, rel=1e-9) and r.n_known == found[r.doc_id].n_known for r in same)


def test_word_probabilities_sum_to_one(spark, sf_dir):
    """Of a class's rare words, and the one share for unseen words; every frequent word has a place of its own."""
    counts = lbl.word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    words = lbl.vocabulary(counts)
    mass, places = Counter(), Counter()
    for r in counts.collect():
        place = int(words.ids([bytes(r.word)])[1][0])
        places[place] += r.c
        if place % lbl.SLOTS == 0:
            mass[place // lbl.SLOTS] += (r.c + 1) / 10 ** words.log_size[place // lbl.SLOTS]
    assert len(mass) == lbl.CLASSES
    for k, m in mass.items():
        assert m + 1 / 10 ** words.log_size[k] == pytest.approx(1)
    assert sum(p % lbl.SLOTS > 0 for p in places) == lbl.CLASSES * (lbl.SLOTS - 1)
    n = sum(places.values()) + (words.share > 0).sum()
    assert all(words.share[p] == pytest.approx((c + 1) / n) for p, c in places.items())


def shingle_set(text):
    w = text.encode().translate(shingles.ASCII_LOWER).split()
    return frozenset(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_links(rows, threshold=0.8):
    """links, text_links and class of each document, by comparing all that share a shingle."""
    sets = {r[0]: shingle_set(r[1] or "") for r in rows}
    by = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    links, texts, parent = Counter(), defaultdict(set), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j in {j for x in s for j in by[x]}:
            if i != j and len(s & sets[j]) >= threshold * len(s | sets[j]):
                links[i] += 1
                if s != sets[j]:
                    texts[i].add(sets[j])
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (links[i], len(texts[i]), root(i)) for i in sets}


@pytest.mark.parametrize("chunk", [512, 7])
def test_near_duplicates_against_brute_force(spark, monkeypatch, tmp_path, chunk):
    monkeypatch.setattr(near_dup, "CHUNK_TEXTS", chunk)
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(400)]
    rows = []
    for i in range(300):
        if i and rng.random() < 0.5:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words = words[: rng.randrange(3, len(words) + 1)]
            if len(words) < 3:
                words = [rng.choice(vocabulary) for _ in range(40)]
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 90))]
        rows.append((i, " ".join(words)))
    base = [rng.choice(vocabulary) for _ in range(120)]
    for i in range(300, 420):  # one large group of different near copies
        words = list(base)
        words[rng.randrange(120)] = f"n{i}"
        rows.append((i, " ".join(words)))
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    expected = brute_links(rows)
    found = {r.doc_id: (r.links, r.text_links, r.class_id) for r in near_dup.join(spark.read.parquet(path)).collect()}
    wrong = [(i, found[i], expected[i]) for i in expected if found[i] != expected[i]]
    assert not wrong, wrong[:5]


def test_chunk_without_a_member(spark, monkeypatch, tmp_path):
    """Pairs of long near copies cut into two chunks, where often both fall into the same."""
    rng = random.Random(4)
    rows = []
    for i in range(24):
        words = [f"u{i}x{rng.randrange(10**6)}" for _ in range(200)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words, "end"]))]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    monkeypatch.setattr(near_dup, "CHUNK_BYTES", 2000)  # a set has 196 or 197 shingles of 8 bytes
    found = {r.doc_id: (r.links, r.text_links, r.class_id) for r in near_dup.join(spark.read.parquet(path)).collect()}
    assert found == {i: (1, 1, i - i % 2) for i in range(48)}


def test_hot_group_leaves_the_depth(spark, tmp_path):
    """Many links of high similarity don't lower the share found just over the threshold."""
    rng = random.Random(5)
    base = [f"v{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(i, " ".join([*base, f"n{i}"])) for i in range(60)]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    found = near_dup.join(spark.read.parquet(path)).collect()
    assert {r.links for r in found} == {59}
    assert all(near_dup.found_share(near_dup.THRESHOLD, r.depth) >= near_dup.TARGET for r in found)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_recall_against_an_exact_join(spark, tmp_path, threshold):
    """Pairs of a similarity at or a little over the threshold; every link has to be found, at the query's and at lower thresholds."""
    rng = random.Random(11)
    rows = []
    for i in range(400):
        words = [f"p{i}x{k}" for k in range(104)]
        other = list(words)
        same = int(np.ceil(200 * threshold / (1 + threshold))) + rng.randrange(3)  # shared shingles of 100 each
        for k in range(same + 4, 104):
            other[k] = f"q{i}x{k}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    expected = brute_links(rows, threshold)
    assert sum(e[0] for e in expected.values()) >= 600
    found = near_dup.join(spark.read.parquet(path), threshold).collect()
    assert {r.doc_id: (r.links, r.text_links, r.class_id) for r in found} == expected
    assert found[0].recall >= near_dup.TARGET


def test_shortened():
    assert near_dup.shortened(0.8, 0.9995) == (4, near_dup.TREES)
    for t in (0.05, 0.2, 0.35, 0.5, 0.99):
        depth, trees = near_dup.shortened(t, 0.9995)
        assert near_dup.found_share(t, depth, trees) >= 0.9995
        assert depth == near_dup.DEPTH or near_dup.found_share(t, depth + 1, near_dup.TREES) < 0.9995
    with pytest.raises(ValueError):
        near_dup.shortened(0.0, 0.9)


@pytest.mark.parametrize("parts", [1, 7])
def test_trie_runs_across_ranges(spark, monkeypatch, parts):
    """Runs are joined up over the ranges they are cut into, equal signatures too."""
    monkeypatch.setattr(near_dup, "partitions", lambda spark: parts)
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 3, (300, 2, near_dup.DEPTH)).astype(">u4")
    keys[100:220] = keys[100]
    nodes = spark.createDataFrame([(i, bytearray(k.tobytes())) for i, k in enumerate(keys)], "rep long, keys binary")
    leaves = staged(near_dup.forest(nodes, 2), "test-leaves")
    for depth in (1, 3, 6):
        links = near_dup.trie_links(leaves, depth).collect()
        parent = list(range(300))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for r in links:
            parent[root(r.u)] = root(r.v)
        shared = defaultdict(set)
        for i, k in enumerate(keys):
            for t in range(2):
                shared[t, k[t, :depth].tobytes()].add(i)
        assert all(len({root(i) for i in s}) == 1 for s in shared.values())
        assert all(any(keys[r.u, t, :depth].tobytes() == keys[r.v, t, :depth].tobytes() for t in range(2)) for r in links)
        assert len(links) <= 600


def test_overlaps():
    rng = np.random.default_rng(0)
    found = [np.unique(rng.integers(0, 300, 60)).astype(np.uint64) for _ in range(70)]
    table = near_dup.overlaps(found)
    for i in range(70):
        for j in range(70):
            if i != j:
                assert table[i, j] == len(np.intersect1d(found[i], found[j]))


def test_shingles_do_not_depend_on_neighbours_or_steps():
    texts = [b"a b c d e f A", b"one", b"", b"x  y\nz", b"a b c d e", "é ü 日 本 x y".encode()]
    h, n = shingles.shingle_hashes(texts)
    ends = n.cumsum()
    for t, e, k in zip(texts, ends, n, strict=True):
        alone, m = shingles.shingle_hashes([t])
        assert (alone == h[e - k : e]).all() and m[0] == k
    long = b" ".join(b"w%d" % (i % 977) for i in range(20_000))
    a, b = shingles.word_hashes([long, b"x y"]), shingles.word_hashes([long, b"x y"], step=1000)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_components(spark):
    from tracelake.llm.graph import components

    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (200, 200)] + [(300, i) for i in range(301, 340)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100} | {i: 300 for i in range(300, 340)}
