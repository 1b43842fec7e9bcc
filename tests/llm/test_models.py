"""Language-model scores by brute force, and the quality classifier's held-out accuracy."""

import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from weird import documents, lower, texts

from sparkhist.llm import _common, grams, infinigram, quality


def words(text):
    return (text or "").encode().lower().split() + [infinigram.END]


def brute(train, asked):
    docs = [words(t) for t in train]
    unigrams = Counter(w for d in docs for w in d)
    total, distinct = sum(unigrams.values()), len(unigrams)
    out = []
    for t in asked:
        q = words(t)
        base = model = 0.0
        for i, w in enumerate(q):
            p1 = p = (unigrams[w] + 1) / (total + distinct + 1)
            for n in range(i, 0, -1):
                seen = [d[e] for d in docs for e in range(n, len(d)) if d[e - n : e] == q[i - n : i]]
                if seen:
                    p = (seen.count(w) + infinigram.MASS * p1) / (len(seen) + infinigram.MASS)
                    break
            base += math.log10(p1)
            model += math.log10(p)
        out.append((len(q), sum(unigrams[w] > 0 for w in q), base, model))
    return out, total, distinct


@pytest.mark.parametrize("seed", range(4))
def test_scores_brute_force(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range([2, 3, 8, 40][seed])]
    make = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 5, 30])))
    train = [make() for _ in range(30)]
    train += [train[0]] * 12 + [train[3] + " x " + train[4]] + ["a a a a a a a a"] * 3
    other = [make() for _ in range(10)] + train[:6] + ["zz " + train[5], train[4] + " " + train[3], "un known", ""]
    for cls, asked in ((infinigram.Unseen, other), (infinigram.Learned, train)):
        want, total, distinct = brute(train, asked)
        batch = cls([infinigram.word_hashes(t) for t in asked])
        for k in range(3):
            batch.visit(infinigram.Shard.build([infinigram.word_hashes(t) for t in train[k::3]]).open())
        for got, w in zip(zip(*batch.result(total, distinct)), want):
            assert got == pytest.approx(w, abs=1e-9)


def test_texts_built_to_collide_are_told_apart():
    """The Thue-Morse sequence and its complement have one polynomial hash modulo 2^64, whatever the base."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    one, two = (" ".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    shard = infinigram.Shard.build([infinigram.word_hashes(one), infinigram.word_hashes("b " + two)]).open()
    texts = infinigram.Unseen([infinigram.word_hashes(two), infinigram.word_hashes("x")])
    texts.meet(shard)
    mine, theirs = infinigram.reverse_texts([infinigram.word_hashes(t) for t in (two, "x")])[0], []
    for t in (one, "b " + two):
        theirs += infinigram.reverse_texts([infinigram.word_hashes(t)])[0].tolist()
    rng = np.random.default_rng(0)
    a = np.concatenate([[0, 0, 1, 1], rng.integers(0, 1500, 40)])
    b = np.concatenate([[0, 2050, 1, 2051], rng.integers(0, 4000, 40)])
    assert texts.prefix[2049] - texts.prefix[1] == shard.prefix[2049] - shard.prefix[1]  # they do collide
    most = texts.rest[a].astype(np.int64)
    for i, j, n in zip(a.tolist(), b.tolist(), texts.common(shard, a, b, most).tolist()):
        true = 0
        while true < texts.rest[i] and i + true < len(mine) and j + true < len(theirs) and mine[i + true] == theirs[j + true] and theirs[j + true]:
            true += 1
        assert n == true, (i, j, n, true)


def test_suffix_array():
    rng = random.Random(0)
    for n in (1, 2, 50, 400):
        tokens = [rng.randint(1, 3) for _ in range(n - 1)] + [9]
        order = infinigram.suffix_array(np.array(tokens, np.int32), 4, 3)
        assert order.tolist() == sorted(range(n), key=lambda i: tokens[i:])


@pytest.mark.parametrize("shard_bytes", [10**9, 400])
def test_scores_in_spark(spark, shard_bytes):
    rows = [r for r in texts() if r[1] is None or len(r[1]) < 10_000]
    learn = [i is None or i % 3 != 0 for i, _ in rows]
    want, total, _ = brute([t for (_, t), use in zip(rows, learn) if use], [t for _, t in rows])
    trains = F.col("doc_id").isNull() | (F.col("doc_id") % 3 != 0)
    got = infinigram.score(documents(spark, rows), trains, shard_bytes=shard_bytes).collect()
    key = lambda r: (str(r[0]), *(round(x, 6) for x in r[1:]))
    mine = sorted(key((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score)) for r in got)
    assert mine == sorted(key((i, *w)) for (i, _), w in zip(rows, want))
    assert {r.train_tokens for r in got} == {total}


@pytest.mark.parametrize("seed", range(3))
def test_scores_by_counted_grams(spark, seed):
    """Many chunks, counting tasks and shards of passages; copies of passages at all places and of all lengths."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range([3, 12, 300][seed])]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows = [make(rng.choice([0, 1, 7, 8, 9, 40])) for _ in range(60)]
    for _ in range(60):
        a, b = rng.choice(rows), rng.choice(rows)
        i, j = sorted(rng.randint(0, len(a)) for _ in range(2))
        rows.append(rng.choice([a, a[:i] + a[j:], a[i:j] + b, b[: len(b) // 2] + a[i:j] + make(3) + a[i:], a[:j]])[:90])
    rows += [["a"] * 30, ["a"] * 29, ["b"] + ["a"] * 25, ["n1", "n2"], ["a"] * 30]
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    rng.shuffle(rows)
    want, total, _ = brute([t for i, t in rows if i % 3], [t for _, t in rows])
    src = documents(spark, rows).select("doc_id", "text", (F.col("doc_id") % 3 != 0).alias("learned")).repartition(3)
    scored, tokens = grams.score(src, 200, 100)
    mine = {r.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in scored.collect()}
    assert tokens == total and len(mine) == len(rows)
    for (i, _), w in zip(rows, want):
        assert mine[i] == pytest.approx(w, abs=1e-9)


def test_scores_of_repetitive_texts(spark):
    """Long runs of a word or a line, and texts built to collide, score as in one shard."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    one, two = (" ".join("uv"[b ^ flip] for b in bits) for flip in (0, 1))
    some = ["a " * 20_000, "a " * 19_000, "x y z\n" * 5000, "b " + "x y z\n" * 6000, "a " * 300 + "b", one]
    rows = list(enumerate(some * 3 + [two, "v " + two + " v"]))
    docs, trains = documents(spark, rows), F.col("doc_id") < 8
    by_id = []
    for shard_bytes in (10**9, 10_000):
        got = infinigram.score(docs, trains, shard_bytes=shard_bytes).collect()
        by_id.append({r.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in got})
    assert len(by_id[0]) == len(by_id[1]) == len(rows)
    for i, _ in rows:
        assert by_id[1][i] == pytest.approx(by_id[0][i], rel=1e-9)


def test_texts_without_company_visit_no_shard(spark):
    """Every text visited every shard of the corpus."""
    folder = Path(_common.shared_dir(spark).removeprefix("file:"))
    rng = random.Random(0)
    rows = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(60))) for i in range(300)]
    shards = lambda: set(folder.glob("sparkhist-shards-*/shard-*"))
    before = shards()
    got = infinigram.score(documents(spark, rows), F.col("doc_id") % 7 != 2, shard_bytes=5000).collect()
    assert len(got) == 300 and shards() == before


def test_scores_of_empty_tables(spark):
    assert infinigram.lm_digest(documents(spark, [])).count() == 0
    nothing = infinigram.score(documents(spark), F.lit(False)).collect()
    assert all(r.score == r.base_score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in nothing)


def test_held_out_texts_gain(spark, sf):
    got = infinigram.lm_digest(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score <= 0 and r.base_score <= 0 for r in got)
    assert lower("É A") == "É a"


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_digest(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good = [r for r in got if r.quality]
    bad = [r for r in got if not r.quality]
    assert sum(r.kept for r in good) >= 0.98 * len(good) and sum(r.kept for r in bad) <= 0.4 * len(bad)
    assert np.mean([r.expected_grade for r in good]) > 1 > np.mean([r.expected_grade for r in bad])


def test_quality_weird_rows(spark):
    labels = spark.createDataFrame([(1, None, 1), (None, 1, 1), (5, 0, None), (6, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_digest(documents(spark), labels).collect()
    assert len(got) == len(texts()) and all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in got)
    assert quality.quality_digest(documents(spark), labels.limit(0)).count() == len(texts())
    assert quality.quality_digest(documents(spark, []), labels).count() == 0


def test_ordinal_regression():
    rng = np.random.default_rng(0)
    n = 1500
    x = rng.normal(size=n)
    y = np.digitize(2 * x + rng.logistic(size=n), [-1.0, 2.0])
    model = quality.fit_ordinal(np.arange(n + 1), np.zeros(n, np.int64), x, y, 3, rounds=400, l2=0.0)
    assert model.weights[0] == pytest.approx(2, abs=0.3)
    assert model.cuts == pytest.approx([-1, 2], abs=0.3) and (np.diff(model.cuts) > 0).all()
    tails = model.tails(np.array([-3.0, 0.0, 3.0]))
    assert (np.diff(tails, axis=1) < 0).all() and (np.diff(tails, axis=0) > 0).all()


def test_quality_counts_all_capitals():
    feature = lambda n: quality.crc32(f"#upper{n}".encode()) % quality.DIMS
    index, _ = quality.hashed("aBBBBBBaBBBBBBaBBBBBB")  # every seventh letter is small
    assert feature(17) in index and feature(0) not in index
    for text in ("", "Ab cÉ ÄÖü ǅ Ⅷ 日本 XYZ", "a" * 9 + "B"):
        assert quality.capitals(text) == sum(map(str.isupper, text))


def test_quality_learns_from_all_of_a_long_text(spark):
    text = " ".join("w" + "".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(9000))
    rows = spark.createDataFrame([(i, text if i % 2 else "other", i % 2) for i in range(12)], "doc_id long, text string, g int")
    model = quality.fit(rows.drop("g"), rows.drop("text"), F.col("g"), 2)
    assert (model.weights[quality.hashed(text)[0]] != 0).all()
