"""The pipeline against its stages one by one, and by brute force."""

import importlib
import os
import subprocess
import sys
from collections import Counter

import corpus_pipeline
from test_shingles import near, sets
from weird import LINE, documents, keepers

from sparkhist.llm import mixing, simhash, tokens, toxicity


def test_stages(spark, tmp_path):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    state = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, state, d)
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if name != "packing":
            assert after.columns == columns
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
            want = {r.doc_id for r in toxicity.score(docs, model).collect() if not r.predicted}
            assert {r.doc_id for r in after.collect()} == want and len(want) < docs.count()
        if name == "line_dedup":
            assert after.count() == state.count()
            assert sum(len(r.text) for r in after.collect()) < sum(len(r.text) for r in state.collect())
            assert all(r.n_chars == len(r.text) for r in after.collect())
        if name == "simhash_near_dedup":
            rows = [(r.doc_id, r.text) for r in state.collect()]
            s, fps = [sets(t) for _, t in rows], [simhash.fingerprint(t) for _, t in rows]
            linked = [(i, j) for i in range(len(rows)) for j in range(i) if near(s, fps, i, j)]
            assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, _ in keepers(rows, linked))
        if name == "mixing":
            want = Counter({r.doc_id: r.times for r in mixing.plan(state).collect()})
            assert Counter(r.doc_id for r in after.collect()) == +want
        if name == "packing":
            copies = Counter(r.doc_id for r in state.collect())
            text = {r.doc_id: r.text for r in state.collect()}
            total = Counter()
            for r in after.collect():
                total[r.doc_id] += r.length
            assert total == Counter({i: n * (len(tokens.encoder().ids(text[i])) + 1) for i, n in copies.items()})
        state = after
    whole = corpus_pipeline.run(spark, d)
    assert whole.agg({"length": "sum"}).first()[0] == state.agg({"length": "sum"}).first()[0]


def test_weird_rows(spark, sf, tmp_path):
    """Nulls, repeated ids and rows, long and empty texts, clashing columns: each stage against what it should keep."""
    state = documents(spark)
    columns = state.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, state, sf).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        assert name == "packing" or after.columns == columns
        old, new = state.collect(), after.collect()
        if name == "toxicity":
            assert Counter(r.text for r in new) <= Counter(r.text for r in old) and len(new) >= len(old) - 2
        if name == "line_dedup":
            assert Counter(r.doc_id for r in new) == Counter(r.doc_id for r in old)
            kept = [r.text for r in new if LINE in (r.text or "")]
            assert len(kept) == 2 and all(r.doc_id == 30 for r in new if r.text in kept)  # the largest id, in both its rows
        if name == "simhash_near_dedup":
            rows = [(r.doc_id, r.text) for r in old]
            s, fps = [sets(t) for _, t in rows], [simhash.fingerprint(t) for _, t in rows]
            linked = [(i, j) for i in range(len(rows)) for j in range(i) if near(s, fps, i, j)]
            assert sorted(str(r.doc_id) for r in new) == sorted(str(i) for i, _ in keepers(rows, linked))
        if name == "mixing":
            want = Counter()
            for r in mixing.plan(state).collect():
                want[r.doc_id] += r.times
            assert Counter(r.doc_id for r in new) == +want
        if name == "packing":
            total = sum(len(tokens.encoder().ids(r.text or "")) + 1 for r in old)
            assert sum(r.length for r in new) == total and {r.doc_id for r in new} == {r.doc_id for r in old}
        state = after
    state = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        state = stage(spark, state, sf)
    assert state.count() == 0


def test_rest_works_without_these_operators(tmp_path):
    """With the subpackage and the pipeline gone, the entry module still imports."""
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, *_):\n"
        "        if name == 'corpus_pipeline' or name.startswith('sparkhist.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not any(q.startswith('op') for q in e.queries()) and 'pipeline' not in e.queries()\n"
        "assert set(e.oracle_sql()) <= set(e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
    broken = code.replace("name == 'corpus_pipeline' or name.startswith('sparkhist.llm')", "name == 'sparkhist.llm.tokens'")
    assert subprocess.run([sys.executable, "-c", broken], cwd=root, capture_output=True).returncode  # isn't swallowed
    entry = importlib.import_module("__spark_entry__")
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in entry.queries()} and "pipeline" in entry.queries()
