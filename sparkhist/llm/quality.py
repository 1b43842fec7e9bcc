"""Quality grades by ordinal cumulative-link regression on hashed text.

    P(grade <= k) = 1 / (1 + exp(-(cut[k] - w . x)))

One weight vector w over hashed tokens serves all grades; the cuts are kept
in order by construction.  Expected grade and tail probability follow for
selecting documents.  Fitting uses a bounded sample of rated rows, whose
hashed features reach the driver; scoring is one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkhist.llm._common import crc_mod, materialize, one_text_each, sliced

#: Rated rows to learn from, at most.
SAMPLE = 6_000
DIMS = 1 << 18
#: Tokens whose feature a worker remembers before it starts afresh.
CACHE = 200_000
#: Documents whose tail probability reaches this are kept.
KEEP = 0.35
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+")
WIDE = re.compile(r"[^\x00-\x7f]+")
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def capitals(text: str) -> int:
    """Upper-case letters of a whole text, those of ASCII counted in bulk."""
    raw = text.encode()
    return len(raw) - len(raw.translate(None, CAPITALS)) + sum(map(str.isupper, "".join(WIDE.findall(text))))


def hashed(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices, which may repeat, and values of the hashed features of a whole text: words and traits of its shape."""
    text = text or ""
    counts = Counter(TOKEN.findall(text.lower()))
    n = sum(counts.values())
    lines = text.split("\n")
    words = text.split()
    level = lambda v: int(np.ceil(4 * np.log1p(v)))
    share = lambda v: int(20 * v)
    traits = [
        f"#words{level(len(words))}",
        f"#lines{level(len(lines))}",
        f"#symbols{share(sum(c for t, c in counts.items() if not t[0].isalnum()) / max(1, n))}",
        f"#digits{share(sum(c for t, c in counts.items() if t[0].isdigit()) / max(1, n))}",
        f"#distinct{share(len(set(words)) / max(1, len(words)))}",
        f"#repeats{share(1 - len(set(lines)) / len(lines))}",
        f"#top{share(max(counts.values(), default=0) / max(1, n))}",
        f"#length{level(len(text) / max(1, len(words)))}",
        f"#upper{share(capitals(text) / max(1, len(text)))}",
    ]
    value = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    value = np.concatenate([value / (np.sqrt((value * value).sum()) or 1.0), np.full(len(traits), 0.5)])
    return np.fromiter(map(_index, [*counts, *traits]), np.int64, len(value)), value


_known: dict[str, int] = {}


def _index(token: str) -> int:
    """The feature of a token or trait; kept for those met before."""
    i = _known.get(token)
    if i is None:
        if len(_known) >= CACHE:
            _known.clear()
        i = _known[token] = crc32(token.encode()) % DIMS
    return i


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Ordinal:
    """Shared weights and ordered cuts between grades 0 .. len(cuts)."""

    weights: np.ndarray
    cuts: np.ndarray

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, one row per score w . x."""
        return 1 - _sigmoid(self.cuts[None, :] - z[:, None])


def fit_ordinal(
    indptr: np.ndarray, index: np.ndarray, value: np.ndarray, y: np.ndarray, grades: int, rounds: int = 150, l2: float = 0.3
) -> Ordinal:
    """Maximum likelihood with a ridge by full-batch Adam steps."""
    n = len(y)
    used, inverse = np.unique(index, return_inverse=True)
    row = np.repeat(np.arange(n), np.diff(indptr))
    w = np.zeros(len(used))
    share = np.clip([(y <= k).mean() for k in range(grades - 1)], 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    theta = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    mw, vw, mt, vt = np.zeros_like(w), np.zeros_like(w), np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        cuts = theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(theta[1:]))])
        z = np.bincount(row, value * w[inverse], n)
        c = np.concatenate([np.ones((n, 1)), 1 - _sigmoid(cuts[None, :] - z[:, None]), np.zeros((n, 1))], 1)
        rows = np.arange(n)
        p = np.maximum(c[rows, y] - c[rows, y + 1], 1e-9)
        s = c * (1 - c)  # slope of each tail in z
        gz = -(s[rows, y] - s[rows, y + 1]) / p
        gc = np.zeros((n, grades - 1))
        for k in range(grades - 1):  # tail k+1 falls as cut k rises
            gc[:, k] = np.where(y == k + 1, s[:, k + 1], np.where(y == k, -s[:, k + 1], 0.0)) / p
        gcut = gc.sum(0)
        gt = np.concatenate([[gcut.sum()], [gcut[k:].sum() * np.exp(theta[k]) for k in range(1, grades - 1)]])
        gw = np.bincount(inverse, value * gz[row], len(w)) + l2 * w
        for g, x, m, v, rate in ((gw, w, mw, vw, 0.1), (gt, theta, mt, vt, 0.05)):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    full = np.zeros(DIMS)
    full[used] = w
    return Ordinal(full, theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(theta[1:]))]))


def fit(
    docs: DataFrame, ratings: DataFrame, grade: Column, grades: int, id_col: str = "doc_id", text_col: str = "text",
    sample: int = SAMPLE,
) -> Ordinal:
    """Learn from at most `sample` rated rows whose crc32(id as text) mod 4 isn't 2.

    `grade` is a column over `ratings` from 0 to grades - 1.  Rows without
    grade or id teach nothing; without any row all grades are even.  An id
    with several grades has the lowest of them, one of several texts is used.
    """
    ids = (
        ratings.select(F.col(id_col).alias("_q_id"), grade.cast("int").alias("y"))
        .where(F.col("y").isNotNull() & F.col("_q_id").isNotNull() & (crc_mod("_q_id", 4) != 2))
        .groupBy("_q_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("_q_id"), "_q_id").limit(sample)
    )
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = src.join(F.broadcast(materialize(ids, "rated")), F.col("doc_id") == F.col("_q_id"))
    rows = one_text_each(rows.select("doc_id", "text", "y"), "doc_id").select("text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out = []
            for t in b.column("text"):
                i, v = hashed(t.as_py())
                out.append((i.astype(np.int32), v.astype(np.float32)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.list_(pa.int32())), pa.array([x[1] for x in out], pa.list_(pa.float32())), b.column("y")],
                names=["i", "v", "y"],
            )

    got = rows.mapInArrow(run, "i array<int>, v array<float>, y int").toArrow()
    y = got.column("y").to_numpy()
    if not len(y):
        return Ordinal(np.zeros(DIMS), np.log(np.arange(1, grades) / np.arange(grades - 1, 0, -1)))
    index = [np.asarray(x.values) for x in got.column("i")]
    value = [np.asarray(x.values) for x in got.column("v")]
    order = sorted(range(len(y)), key=lambda k: (y[k], len(index[k]), crc32(index[k].tobytes())))
    index, value, y = [index[k] for k in order], [value[k] for k in order], y[order]
    indptr = np.concatenate([[0], np.cumsum([len(x) for x in index])])
    return fit_ordinal(indptr, np.concatenate(index), np.concatenate(value).astype(float), y, grades)


def grade(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text", tail: int = 1) -> DataFrame:
    """Per row: doc_id, held_out, expected_grade, tail_probability (of `tail` or more), kept.

    A null text counts as empty; a null id isn't held out; repeated rows each
    get a line; other columns are not read; an empty table gives no line.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            z = []
            for t in b.column("text"):
                i, v = hashed(t.as_py())
                z.append(float(model.weights[i] @ v))
            tails = model.tails(np.array(z))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(tails.sum(1)), pa.array(tails[:, tail - 1])],
                names=["doc_id", "expected_grade", "tail_probability"],
            )

    out = src.mapInArrow(run, f"doc_id {kind}, expected_grade double, tail_probability double")
    return out.select(
        "doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "expected_grade", "tail_probability", (F.col("tail_probability") >= KEEP).alias("kept"),
    )


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Grades 0 (poor), 1 (good but toxic) and 2 (good) of all documents; kept from grade 1 on."""
    rating = F.col("quality") * (2 - F.coalesce(F.col("toxic"), F.lit(0)))
    return grade(docs, fit(docs, labels, rating, 3))
