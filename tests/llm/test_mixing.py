import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from weird import documents, texts

from sparkhist.llm import mixing

WORD = re.compile("[^\x20\x09-\x0d]+")


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2], 300) == pytest.approx([150, 50, 100])
    assert mixing.targets([10, 100, 100], [3, 1, 2], 315) == pytest.approx([20, 98.3333333, 196.6666667])
    assert mixing.targets([1, 1], [3, 1], 100) == [2, 2] and mixing.targets([0, 5], [3, 1], 7.5) == [0, 7.5]
    assert mixing.targets([], [], 0) == []


def check(rows, sources):
    per = defaultdict(lambda: [0, 0, None, 0])
    for r, s in zip(rows, sources):
        p = per[s]
        p[0] += r.size
        p[1] += r.taken
        p[2], p[3] = r.target, r.source_size
        assert 0 <= r.taken <= 2 * r.size
    order = sorted(per, key=lambda s: (s is None, s or ""))
    goal = mixing.targets([per[s][0] for s in order], [[3, 1, 2][i % 3] for i in range(len(order))], 1.5 * sum(p[0] for p in per.values()))
    for s, t in zip(order, goal):
        size, taken, target, source_size = per[s]
        assert size == source_size and target == pytest.approx(t)
        yield s, taken, target, size


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    source = {r.doc_id: r.source for r in docs.collect()}
    got = mixing.mix_digest(docs).collect()
    assert {r.doc_id: r.size for r in got} == {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()}
    for _, taken, target, size in check(got, [source[r.doc_id] for r in got]):
        assert abs(taken - target) <= 0.03 * size
    again = mixing.mix_digest(docs.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_weird_rows(spark):
    docs = documents(spark)
    got = mixing.plan(docs).collect()
    assert len(got) == len(texts())
    for r in got:
        assert r.times in (0, 1, 2)
    assert sum(r.size for r in got) == sum(len(WORD.findall(t or "")) for _, t in texts())
    assert mixing.mix_digest(documents(spark, [])).count() == 0
    assert mixing.mix_digest(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).first().taken == 0


def test_mixed_rows(spark):
    docs = documents(spark)
    want = Counter()
    for r in mixing.plan(docs).collect():
        want[r.doc_id, r.source, r.size] += r.times
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = Counter((r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in mixed.collect())
    assert got == +want
    assert mixing.mix(documents(spark, [])).count() == 0


def test_flights_keep_both_totals():
    rng = np.random.default_rng(1)
    sizes = np.sort(rng.integers(0, 1000, 3000))[::-1].astype(float)
    pi = np.full(3000, 0.37)
    p = mixing.flight(sizes, pi, rng)
    assert ((p > 0) & (p < 1)).sum() <= 2
    assert (p * sizes).sum() == pytest.approx((pi * sizes).sum(), rel=1e-9)
    assert p.sum() == pytest.approx(pi.sum(), rel=1e-9)
    landed = mixing.land(sizes, p, pi)
    assert set(landed) <= {0.0, 1.0} and abs((landed * sizes).sum() - (pi * sizes).sum()) <= 2
    share = np.mean([mixing.flight(sizes[:200], pi[:200], np.random.default_rng(s)) for s in range(300)], axis=0)
    assert abs(share - 0.37).max() < 0.15  # each row as often as it should be


def test_blocks_land_together(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 50)
    rows = [(i, "w " * (i % 17), f"s{i % 2}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_digest(docs).collect()
    assert len(got) == 1000
    for _, taken, target, _size in check(got, [f"s{r.doc_id % 2}" for r in got]):
        assert abs(taken - target) <= 20
