import math

import numpy as np
import pytest
from weird import components

from sparkhist.llm import ann, embedding_dedup

NAN, INF = float("nan"), float("inf")
BAD = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [NAN] + [1.0] * 7, [INF] + [1.0] * 7]


def table(spark, rows):
    schema = "vec_id long, embedding array<float>, label int, rank int, list int, n int, score string"
    return spark.createDataFrame([(*r, 1, 2, 3, "s") for r in rows], schema).repartition(3)


def clustered(seed=0, copies=40):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(6):
        center = rng.normal(size=8)
        rows += [(len(rows) + k, (center + 0.12 * rng.normal(size=8)).tolist(), c % 2) for k in range(copies)]
    rows += [(len(rows) + k, rows[3][1], 1) for k in range(30)]  # equal vectors
    rows += [(len(rows) + k, (5 * np.array(rows[3][1])).tolist(), 1) for k in range(3)]
    return rows


@pytest.mark.parametrize("chunk, small", [(768, 24), (8, 2)])
def test_dedup_brute_force(spark, monkeypatch, chunk, small):
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    monkeypatch.setattr(embedding_dedup, "SMALL", small)
    rows = clustered()
    n = len(rows)
    rows += [(n + k, v, 1) for k, v in enumerate(BAD)] + [(n + 20, rows[0][1], None), (n + 21, rows[3][1][:5], 1)]
    rows += [(None, rows[0][1], 0), (2, rows[2][1], rows[2][2])]
    got = embedding_dedup.near_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    ok = [i for i, (k, v, lab) in enumerate(rows) if k is not None and lab is not None and v and v not in BAD[2:]]
    x = [np.array(rows[i][1], np.float32).astype(float) for i in ok]
    links = {i: 0 for i in range(len(rows))}
    pairs = []
    for a in range(len(ok)):
        for b in range(a):
            i, j = ok[a], ok[b]
            if rows[i][2] == rows[j][2] and len(x[a]) == len(x[b]):
                if x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) >= 0.93:
                    links[i] += 1
                    links[j] += 1
                    pairs.append((i, j))
    comp = components(range(len(rows)), pairs)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[comp[i]] = min(least.get(comp[i], r[0]), r[0])
    want = sorted((str(r[0]), links[i], str(least.get(comp[i])) if r[0] is not None else "None") for i, r in enumerate(rows))
    mine = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got)
    found, true = sum(m[1] for m in mine), sum(w[1] for w in want)
    assert found <= true and found >= 0.97 * true
    if found == true:
        assert mine == want
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_dedup_empty(spark):
    assert embedding_dedup.near_duplicates(table(spark, [])).count() == 0
    only = embedding_dedup.near_duplicates(table(spark, [(1, None, None), (2, [1.0], 0)])).orderBy("vec_id").collect()
    assert [tuple(r) for r in only] == [(1, 0, 1, True), (2, 0, 2, True)]


def nearest(rows, k, step):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v and v not in BAD[2:]]
    out = {}
    for i, q in good:
        if i % step == 0:
            s = sorted((-float(q @ x), j) for j, x in good if j != i and len(x) == len(q))
            out[i] = [(j, -d) for d, j in s[:k]]
    return out


@pytest.mark.parametrize("anchors", [ann.ANCHORS, 60])
def test_search_recall(spark, monkeypatch, anchors):
    monkeypatch.setattr(ann, "ANCHORS", anchors)
    monkeypatch.setattr(ann, "PAIRS", 500)
    monkeypatch.setattr(ann, "ROWS", 64)
    monkeypatch.setattr(ann, "QUERIES", 8)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=8) * rng.uniform(0.5, 3)).tolist(), 0) for i in range(1500)]
    rows += [(2000 + k, v, 1) for k, v in enumerate(BAD)] + [(None, rows[0][1], 0)]
    rows += [(2100 + 20 * k, [float(k), 1.0, 2.0], 0) for k in range(5)]  # another length: fewer than k candidates
    got = ann.ann_digest(table(spark, rows)).collect()
    want = nearest(rows, 20, 20)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == set(want)
    hit = 0
    exact = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if i is not None and v and v not in BAD[2:]}
    for q, found in by.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, len(want[q]) + 1))
        assert all(math.isclose(s, float(exact[q] @ exact[i]), rel_tol=1e-12, abs_tol=1e-12) for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hit += len({i for _, i, _ in found} & {i for i, _ in want[q]})
    assert hit >= 0.9 * sum(map(len, want.values()))


def test_search_ties_and_empty(spark):
    rows = [(i, [1.0, 2.0], 0) for i in range(200)] + [(20, [1.0, 2.0], 0)]
    got = ann.search(table(spark, rows), __import__("pyspark").sql.functions.col("vec_id") == 40, k=5)
    assert [(r["rank"], r.vec_id, r.score) for r in got.orderBy("rank").collect()] == [(k + 1, k, 5.0) for k in range(5)]
    assert ann.ann_digest(table(spark, [])).count() == 0
    assert ann.ann_digest(table(spark, [(20, [1.0], 0)])).count() == 0


def test_search_ties_of_random_vectors(spark):
    """Copies of arbitrary numbers score alike wherever they are met, so equal scores go by id."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 19))
    rows = [(i, base[i % 300].tolist(), 0) for i in rng.permutation(1500).tolist()]
    got = ann.ann_digest(table(spark, rows)).collect()
    want = nearest(rows, 20, 20)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = 0
    for q, found in by.items():
        found.sort()
        of = {}
        for _, i, s in found:
            assert of.setdefault(i % 300, s) == s  # copies have one score
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hit += len({i for _, i, _ in found} & {i for i, _ in want[q]})
    assert hit >= 0.9 * sum(map(len, want.values()))


def test_scores_do_not_depend_on_neighbours():
    rng = np.random.default_rng(1)
    for dim in (1, 7, 8, 64, 129, 300):
        x, q = rng.normal(size=(50, dim)), rng.normal(size=dim)
        all_at_once = ann.scores(x, q[None])
        assert all(ann.scores(x[i : i + 1], q[None])[0] == all_at_once[i] for i in range(50))
        assert (ann.scores(x[::3], q[None]) == all_at_once[::3]).all()


def test_sign_codes_keep_close_pairs():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    assert embedding_dedup._like(embedding_dedup.sign_codes(x), embedding_dedup.sign_codes(y)).all()


def test_rotation_keeps_distances():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 12))
    index = ann.fit(np.arange(300), x, 300, float((x * x).sum(1).max()), 5)
    lifted, q = index.lift(x), index.lift_query(x[:4])
    d = ann._distances(q, lifted)
    assert np.allclose(d, (x[:4] ** 2).sum(1)[:, None] + index.longest - 2 * x[:4] @ x.T)
    assert len(np.unique(index.place(lifted))) > 1


def test_repeated_ids_take_one_place(spark):
    rows = [(20, [1.0, 0.0], 0)] + [(1, [9.0, 0.0], 0)] * 100 + [(100 + i, [8.0 - i / 10, 0.0], 0) for i in range(30)]
    got = ann.search(table(spark, rows), __import__("pyspark").sql.functions.col("vec_id") == 20, k=20)
    assert [r.vec_id for r in got.orderBy("rank").collect()] == [1, *range(100, 119)]
