"""Near-duplicates by word shingles: MinHash bands propose pairs, exact Jaccard similarity decides.

Rows with one text are one class from the start.  Texts that agree in all
rows of a band meet in a bucket.  Each is first compared with the smallest of
its bucket; what that joins needs no comparison any more, so then only pairs
of a bucket that still lie in different components are compared, all of them:
no bucket is cut.  Two texts of similarity s share no bucket with probability
(1 - s^ROWS)^BANDS: 5e-6 at 0.8, less above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkhist.llm._common import connected_components, materialize, sliced, split_join

#: Buckets of every text, and least hashes that must agree in one of them.
BANDS, ROWS = 23, 4
SEED = 42


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a text of fewer words is one shingle, a blank one has none."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII blanks only
    n = max(1, len(words) - shingle + 1) if words else 0
    h = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(b" ".join(words[i : i + shingle]), SEED) for i in range(n)), np.uint64, n))


_rng = np.random.default_rng(SEED)
_XOR, _ODD = (_rng.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) for _ in range(2))
_ODD |= np.uint64(1)
_JOIN = _rng.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The text's bucket in each band, none for a text without shingles."""
    if not len(hashes):
        return hashes
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for i in range(0, len(hashes), 1 << 12):  # bounded memory for very long texts
        x = (hashes[None, i : i + (1 << 12)] ^ _XOR) * _ODD
        x ^= x >> np.uint64(32)
        np.minimum(least, x.min(1), out=least)
    return (least.reshape(BANDS, ROWS) * _JOIN).sum(1, dtype=np.uint64)


def _arrays(texts: DataFrame, make, name: str) -> DataFrame:
    """(text_hash, `name`): what `make` returns for the text of every row, as signed 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out = pa.array([make(t.as_py()).view(np.int64) for t in b.column("text")], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("text_hash"), out], names=["text_hash", name])

    return texts.select("text_hash", "text").mapInArrow(run, f"text_hash long, {name} array<long>")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have at least that Jaccard similarity."""
    pairs = materialize(pairs, "pairs")
    weight = pairs.groupBy("a").agg(F.count("*").alias("n")).withColumnRenamed("a", "text_hash")
    left = materialize(sets.join(weight, "text_hash").select(F.col("text_hash").alias("a"), F.col("hashes").alias("x"), "n"), "left")
    both = split_join(pairs, left, ["a"], "n").join(sets.select(F.col("text_hash").alias("b"), F.col("hashes").alias("y")), "b")
    common = both.select("a", "b", (F.size("x") + F.size("y")).alias("sum"), F.size(F.array_intersect("x", "y")).alias("c"))
    return materialize(common.where(F.col("c") >= similarity * (F.col("sum") - F.col("c")) - 1e-9).select("a", "b"), "near")


def link(texts: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of `texts` (text_hash, text) that are similar and share a bucket.

    Equal texts are one node.  A text of fewer words than a shingle is one
    shingle; blank texts link with nothing.
    """
    keys = _arrays(texts, lambda t: band_keys(shingle_set(t, shingle)), "keys")
    keyed = materialize(keys.select("text_hash", F.explode("keys").alias("k")), "bands")
    heads = keyed.groupBy("k").agg(F.min("text_hash").alias("head"), F.max("text_hash").alias("last"), F.count("*").alias("n"))
    heads = materialize(heads.where("head < last").drop("last"), "heads")
    met = materialize(split_join(keyed, heads, ["k"], "n").select("k", "text_hash", "head").distinct(), "met")
    wanted = materialize(met.select("text_hash").distinct(), "wanted")
    one = texts.join(wanted, "text_hash", "left_semi").dropDuplicates(["text_hash"])
    sets = materialize(_arrays(one, lambda t: shingle_set(t, shingle), "hashes"), "sets")
    star = met.where("text_hash <> head").select(F.col("head").alias("a"), F.col("text_hash").alias("b")).distinct()
    near = _similar(star, sets, similarity)
    placed = connected_components(near).withColumnRenamed("node", "text_hash")
    apart = met.join(placed, "text_hash", "left").select("k", "text_hash", F.coalesce("component", "text_hash").alias("c"))
    apart = materialize(apart, "apart")
    mixed = apart.groupBy("k").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("k")
    apart = materialize(apart.join(mixed, "k", "left_semi"), "mixed")
    others = apart.select("k", F.col("c").alias("c2")).distinct()
    cross = apart.join(others, "k").where("c < c2").join(
        apart.select("k", F.col("c").alias("c2"), F.col("text_hash").alias("text_hash2")), ["k", "c2"]
    )
    cross = cross.select(F.least("text_hash", "text_hash2").alias("a"), F.greatest("text_hash", "text_hash2").alias("b")).distinct()
    return near.unionByName(_similar(cross.join(star, ["a", "b"], "left_anti"), sets, similarity))
