import zlib
from collections import Counter

import numpy as np
from weird import documents, texts

from sparkhist.llm import toxicity


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity_digest(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in got if r.toxic]
    clean = [r for r in got if not r.toxic]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_weird_rows_and_missing_labels(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, None, 1), (None, 1, 1), (5, 0, None), (5, 0, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_digest(docs, labels).collect()
    assert len(got) == len(texts()) and all(r.score == 0 or 0 <= r.score <= 1 for r in got)
    assert all(not r.held_out for r in got if r.doc_id is None)
    assert toxicity.toxicity_digest(documents(spark, []), labels).count() == 0
    assert toxicity.toxicity_digest(docs, labels.limit(0)).where("predicted = 0").count() == len(texts())
    model = toxicity.fit(docs, labels)
    assert toxicity.drop_toxic(docs, model).columns == docs.columns


def test_features():
    none = toxicity.Lexicon()
    assert toxicity.features(None, none) == toxicity.features("123 !!", none) == [0.0] * len(toxicity.NAMES)
    f = dict(zip(toxicity.NAMES, toxicity.features("You are an IDIOT, st00pid idiot!", none)))
    assert f["listed"] == 2 and f["at_you"] == 1 and f["mixed"] >= 1 and f["shouted"] > 0 and f["exclaims"] > 0
    mined = toxicity.Lexicon(frozenset({"zorgo"}), {4: frozenset({"blar"})})
    f = dict(zip(toxicity.NAMES, toxicity.features("zorgo blarting blar", mined)))
    assert f["mined"] == 1 and f["roots"] == 1 and f["any"] == 2


def test_isotonic_and_trees():
    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert x.tolist() == [1, 2.5, 4] and y.tolist() == [0, 0.5, 1]
    x, y = toxicity.isotonic(np.zeros(4), np.array([0.0, 1, 1, 1]))  # equal scores have one mean
    assert x.tolist() == [0] and y.tolist() == [0.75]
    x, y = toxicity.isotonic(np.array([0.0, 1, 1, 2, 2, 2]), np.array([1.0, 0, 1, 1, 0, 0]))
    assert np.allclose(np.interp([0, 1, 2], x, y), [0.5, 0.5, 0.5])
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    raw = toxicity.Trees().fit(x[:1500], y[:1500]).raw(x[1500:])
    assert ((raw > 0) == (y[1500:] > 0)).mean() > 0.95


def test_mining_keeps_accepted_terms_only(spark):
    """A term that is toxic by rate is found beside many others, and what no lexicon takes isn't returned."""
    rows = [("blarg" if i % 2 else "weak", 1, i % 4 // 2) for i in range(80)]
    rows += [("blarg", 0, i % 2) for i in range(60)] + [("plain", 0, i % 2) for i in range(2000)]
    rows += [(f"rare{chr(97 + i)}", 1, f) for i in range(5) for f in (0, 0, 1)]
    size = Counter((f, y) for _, y, f in rows)
    found = lambda: toxicity._mine(spark.createDataFrame(rows, "text string, y int, fold int"), size)
    whole = toxicity._lexicon(found(), (0, 1), size)
    assert "blarg" in whole.words and "plain" not in whole.words
    assert all(any(t in x.words or t[1:] in x.roots.get(int(t[0]) if t[0].isdigit() else 0, ()) for x in
                   (toxicity._lexicon(found(), f, size) for f in ((0,), (1,), (0, 1)))) for t, _ in found())
