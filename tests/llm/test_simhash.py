import random

import pytest
import xxhash
from weird import components, documents, lower, texts

from sparkhist.llm import simhash
from sparkhist.llm._common import connected_components


def slow_fingerprint(text):
    words = [w for w in lower(text).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for text in ["", None, " \n", "one", "one two", "A b C", "a b c d e f g", "Ä Ö a b\tc\x0bd", "x " * 50]:
        assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("crowd", [1, 2, simhash.CROWD])
def test_weird_rows(spark, crowd):
    rows = [r for r in texts() if r[1] is None or len(r[1]) < 10_000]
    got = simhash.near_duplicates(documents(spark, rows), crowd=crowd).collect()
    assert len(got) == len(rows)
    fps = [(i, simhash.fingerprint(t)) for i, t in rows]
    linked = [(f, g) for _, f in fps for _, g in fps if bin(f ^ g).count("1") <= 2]
    comp = components({f for _, f in fps}, linked)
    first = {}
    for i, f in fps:
        if i is not None:
            first[comp[f]] = min(first.get(comp[f], i), i)
    want = sorted((i is None, i or 0, f, first.get(comp[f])) for i, f in fps)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fp % 2**64, r.component_id) for r in got) == want


@pytest.mark.parametrize("crowd", [1, 8, 64])
def test_links_by_distance(spark, crowd):
    rng = random.Random(0)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = set(base)
    for b in base[:6]:
        for _ in range(40):
            b ^= 1 << rng.randrange(64)
            b ^= rng.choice([0, 1 << rng.randrange(64)])
            fps.add(b)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r.node: r.component for r in connected_components(simhash.link(df, crowd)).collect()}
    want = components(signed, [(a, b) for a in signed for b in signed if bin((a ^ b) % 2**64).count("1") <= 2])
    assert all(got.get(f, f) == want[f] for f in signed)


def test_digest_and_keepers(spark):
    docs = documents(spark)
    digest = simhash.simhash_digest(docs)
    assert all(len(r.fingerprint) == 16 and int(r.fingerprint, 16) >= 0 for r in digest.collect())
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    want = {r.component_id for r in digest.collect() if r.component_id is not None}
    assert {i for i in ids if i is not None} == want  # an id of two groups stays in both
    assert simhash.simhash_digest(documents(spark, [])).count() == simhash.keep_first(documents(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(3)
    chains = [(i, i + 1) for i in range(200) if i % 40 != 39]
    star = [(1000, 1000 + i) for i in range(300)]
    wild = [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    edges = chains + star + wild + [(5, 5), (7000, 7000)]
    df = spark.createDataFrame(edges + [(None, 1), (2, None)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == components({n for e in edges for n in e}, edges)
    assert connected_components(df.limit(0)).count() == 0
