"""Base scores by words alone, against brute force, the scores' own and SQL."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F
from weird import documents, texts

from sparkhist.llm import grams, infinigram, queries


def brute(rows, learn):
    words = [(t or "").encode().lower().split() + [infinigram.END] for _, t in rows]
    counts = Counter(w for d, use in zip(words, learn) if use for w in d)
    total = sum(counts.values())
    score = lambda d: sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in d)
    return sorted((str(i), len(d), sum(counts[w] > 0 for w in d), total, round(score(d), 6)) for (i, _), d in zip(rows, words))


def found(df):
    return sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect())


@pytest.mark.parametrize("batch_tokens", [6_000_000, 40])
def test_base_scores(spark, batch_tokens):
    trains = F.col("doc_id").isNull() | (F.col("doc_id") % 3 != 0)
    want = brute(texts(), [i is None or i % 3 != 0 for i, _ in texts()])
    assert found(infinigram.base_score(documents(spark), trains, batch_tokens=batch_tokens)) == want


def test_base_scores_by_many_tasks(spark):
    src = documents(spark).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.coalesce("doc_id", F.lit(1)) % 3 != 0).alias("learned"))
    df, total = grams.base(src, 40, 20)
    assert found(df.withColumn("train_tokens", F.lit(total))) == brute(texts(), [i is None or i % 3 != 0 for i, _ in texts()])


def test_base_scores_of_empty_tables(spark):
    assert infinigram.base_digest(documents(spark, [])).count() == 0
    nothing = infinigram.base_score(documents(spark), F.lit(False)).collect()
    assert len(nothing) == len(texts())
    assert all(r.base_score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in nothing)


def test_lm_base_does_not_score(spark, sf, monkeypatch):
    """It scored all texts by grams of any length, and dropped the scores."""
    score = queries.op8_lm_scoring(spark, sf).drop("score").withColumn("base_score", F.round("base_score", 4))
    want = sorted(map(tuple, score.collect()))

    def refuse(*_, **__):
        raise AssertionError("words are all that lm_base counts")

    monkeypatch.setattr(infinigram, "score", refuse)
    monkeypatch.setattr(grams, "score", refuse)
    got = queries.lm_base(spark, sf)
    assert got.columns == score.columns and got.dtypes == score.dtypes
    assert sorted(map(tuple, got.collect())) == want
