"""Mixing sources to target weights by balanced sampling.

Within a source every row is due target/size times.  The whole part is taken
as it is; the fraction is an inclusion probability, settled by the cube
method (Deville and Tillé, 2004): probabilities move at random through the
null space of two balancing constraints, words and documents, so that both
totals stay exact, until too few fractional rows are left to move.  Blocks of
bounded size fly apart from each other; what each leaves over, two rows or
so, flies again together, and only the last few land by rounding.  Larger
documents fly first, so those that land are the smallest.
"""

from __future__ import annotations

import zlib
from itertools import product
from math import ceil, floor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkhist.llm._common import fresh, materialize, trim

#: Rows of one flight.
BLOCK = 20_000
#: Beyond so many sources their table is joined by a shuffle.
BROADCAST_SOURCES = 10_000
EPS = 1e-9
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[float], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """Shares of `total` by weight, none above `most` times its size, the excess reshared."""
    out = [0.0] * len(sizes)
    free = list(range(len(sizes)))
    left = total
    while free:
        per = left / sum(weights[i] for i in free)
        over = [i for i in free if per * weights[i] > most * sizes[i]]
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
        if not over:
            for i in free:
                out[i] = per * weights[i]
            break
        gone = set(over)
        free = [i for i in free if i not in gone]
    return out


def _null_vector(s: list[float]) -> list[float] | None:
    """A direction that keeps sum(u) and sum(u * s) at zero, if there is one."""
    if len(s) == 3:
        u = [s[2] - s[1], s[0] - s[2], s[1] - s[0]]
        if any(u):
            top = max(map(abs, u))
            return [x / top for x in u]
        return [1.0, -1.0, 0.0]
    if len(s) == 2 and s[0] == s[1]:
        return [1.0, -1.0]
    return None


def flight(sizes: np.ndarray, pi: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move `pi` to 0 or 1 in the null space of words and documents; few stay between."""
    p, s = pi.astype(float).tolist(), sizes.astype(float).tolist()
    rest = iter([i for i in range(len(p)) if EPS < p[i] < 1 - EPS])
    active: list[int] = []
    draws, at = rng.random(4096).tolist(), 0
    while True:
        while len(active) < 3 and (i := next(rest, None)) is not None:
            active.append(i)
        u = _null_vector([s[i] for i in active])
        if u is None:
            break
        up = down = float("inf")
        for i, x in zip(active, u):
            if x > 0:
                up, down = min(up, (1 - p[i]) / x), min(down, p[i] / x)
            elif x < 0:
                up, down = min(up, -p[i] / x), min(down, (p[i] - 1) / x)
        if at == len(draws):
            draws, at = rng.random(4096).tolist(), 0
        step = up if draws[at] * (up + down) < down else -down
        at += 1
        for i, x in zip(active, u):
            p[i] += step * x
            p[i] = 0.0 if p[i] < EPS else 1.0 if p[i] > 1 - EPS else p[i]
        active = [i for i in active if 0 < p[i] < 1]
    return np.array([0.0 if x < EPS else 1.0 if x > 1 - EPS else x for x in p])


def land(sizes: np.ndarray, p: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """Round the few probabilities still between, then trade rows to restore the words.

    A very long row moves little in a flight and may be the one that lands,
    so after rounding, rows of the flight change places with others (or
    alone), each time the trade that brings the words nearest to what `pi`
    asks for, until none helps.
    """
    s = sizes.astype(float)
    x = np.where((p > 0) & (p < 1), 0.0, p)
    between = np.flatnonzero((p > 0) & (p < 1))
    x[between] = min(
        product((0.0, 1.0), repeat=len(between)),
        key=lambda v: (
            abs(sum((a - p[i]) * s[i] for a, i in zip(v, between))),
            abs(sum(a - p[i] for a, i in zip(v, between))),
            v,
        ),
    )
    moving = np.flatnonzero((pi > EPS) & (pi < 1 - EPS))
    for _ in range(64):
        off = float(((x - pi) * s).sum())
        inside, outside = moving[x[moving] == 1], moving[x[moving] == 0]
        best = (abs(off) - 0.5, -1, -1)
        for i, sign in [(inside, -1), (outside, 1)]:
            if len(i):
                d = np.abs(off + sign * s[i])
                k = int(np.argmin(d))
                best = min(best, (float(d[k]), int(i[k]), -1))
        if len(inside) and len(outside):
            order = outside[np.argsort(s[outside], kind="stable")]
            at = np.searchsorted(s[order], s[inside] - off)
            for shift in (-1, 0):
                j = np.clip(at + shift, 0, len(order) - 1)
                d = np.abs(off - s[inside] + s[order[j]])
                k = int(np.argmin(d))
                # A trade keeps the number of rows, so it wins over a move of one row that is no better.
                if d[k] <= best[0]:
                    best = (float(d[k]), int(inside[k]), int(order[j[k]]))
        if best[1] < 0:
            break
        for i in best[1:]:
            if i >= 0:
                x[i] = 1 - x[i]
    return x


def _flier(seed: int, level: int):
    """The flight of one block; a source's only block lands too."""

    def fly(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "h"], ascending=[False, True], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng(zlib.crc32(f"{seed}|{key[0]}|{level}|{key[1]}".encode()))
        p = flight(pdf["size"].to_numpy(), pdf["pi"].to_numpy(), rng)
        if len(pdf) and pdf["blocks"].iloc[0] == 1:
            p = land(pdf["size"].to_numpy(), p, pdf["pi"].to_numpy())
        pdf["pi"] = p
        trim()
        return pdf.drop(columns="block")

    return fly


def plan(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How often each row is taken: doc_id, text_hash, source, size, source_size, target, times.

    Sources in code point order, null last, get `weights` in turn.  One line
    per row of `docs`.  A null text has size 0; repeated rows are units of
    their own; null ids and sources are values like others; a source without
    words has target 0.  The result depends on the rows alone, not on their
    order or partitions.  One line per source comes to the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    units = materialize(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")), "units")
    per = units.groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("size"), F.sum("copies").alias("n")
    ).collect()
    per.sort(key=lambda r: (r.source is None, r.source or ""))
    w = [float(weights[i % len(weights)]) for i in range(len(per))]
    goal = targets([float(r["size"]) for r in per], w, share * sum(r["size"] for r in per), most)
    known, n_of = [], {}
    for i, (r, t) in enumerate(zip(per, goal)):
        ratio = t / r["size"] if r["size"] else 0.0
        base = floor(ratio + EPS)
        known.append((i, r.source, r["size"], float(t), base, max(0.0, ratio - base) if ratio - base > EPS else 0.0))
        n_of[i] = r["n"]
    kind = units.schema["doc_id"].dataType.simpleString()
    sources = spark.createDataFrame(
        known, "sidx int, s_source string, source_size long, target double, base int, pi double"
    )
    sources = F.broadcast(sources) if len(known) <= BROADCAST_SOURCES else sources
    cur = (
        units.join(sources, units["source"].eqNullSafe(sources["s_source"])).drop("s_source")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .drop("copies")
        .withColumn("h", F.xxhash64("doc_id", "text_hash", "size", "copy"))
    )
    names = ["doc_id", "text_hash", "source", "size", "source_size", "target", "base", "pi", "h", "sidx"]
    schema = (
        f"doc_id {kind}, text_hash long, source string, size long, source_size long, target double, "
        "base int, pi double, h long, sidx int, blocks int"
    )
    settled = []
    level = 0
    cur = cur.select(*names)
    while True:
        count = [(i, int(ceil(n / BLOCK))) for i, n in n_of.items()]
        blocks = spark.createDataFrame(count, "sidx int, blocks int") if count else None
        if blocks is None:
            break
        blocks = F.broadcast(blocks) if len(count) <= BROADCAST_SOURCES else blocks

        grouped = cur.join(blocks, "sidx").withColumn("block", F.pmod(F.xxhash64("h", F.lit(level)), F.col("blocks")))
        flown = materialize(grouped.select(*names, "blocks", "block").groupBy("sidx", "block").applyInPandas(_flier(seed, level), schema), "flight")
        settled.append(flown.where("pi = 0 OR pi = 1"))
        cur = flown.where("pi > 0 AND pi < 1").select(*names)
        n_of = {r.sidx: r.n for r in cur.groupBy("sidx").agg(F.count("*").alias("n")).collect()}
        if not n_of:
            break
        level += 1
    if not settled:
        settled = [cur.withColumn("blocks", F.lit(0))]
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.select(
        "doc_id", "text_hash", "source", "size", "source_size", "target",
        (F.col("base") + F.col("pi").cast("int")).cast("long").alias("times"),
    )


def mix_digest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken (words, repeats counted)."""
    return plan(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: each row of `docs` as often as `plan` takes it.

    Rows that agree in id, text and source share what the group is due
    evenly; of those, the smallest as written out get one more where it
    doesn't divide.  Columns may have any names and types.
    """
    keys = fresh(docs, "mix_id", "mix_hash", "mix_source", "mix_times", "mix_rows", "mix_text", "mix_n", "mix_k")
    k_id, k_hash, k_source, times, n_rows, text, n, k = keys
    due = (
        plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
        .groupBy(F.col("doc_id").alias(k_id), F.col("text_hash").alias(k_hash), F.col("source").alias(k_source))
        .agg(F.sum("times").alias(times), F.count("*").alias(n_rows))
        .where(F.col(times) > 0)
    )
    due = materialize(due, "due")
    left = docs.withColumn(text, F.xxhash64(F.col(text_col).cast("string")))
    met = left.join(
        due,
        left[id_col].eqNullSafe(due[k_id])
        & (left[text] == due[k_hash])
        & left[source_col].cast("string").eqNullSafe(due[k_source]),
    )
    each = F.expr(f"{times} div {n_rows}")
    odd = F.col(times) % F.col(n_rows) > 0

    def copies(rows: DataFrame, number) -> DataFrame:
        rows = rows.withColumn(n, number.cast("int")).where(F.col(n) > 0)
        return rows.withColumn(k, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)

    out = copies(met.where(~odd), each)
    if due.where(odd).limit(1).count():
        by = Window.partitionBy(k_id, k_hash, k_source).orderBy(F.struct(*docs.columns).cast("string"))
        ranked = met.where(odd).withColumn(k, F.row_number().over(by))
        more = (F.col(k) <= F.col(times) % F.col(n_rows)).cast("int")
        out = out.unionByName(copies(ranked, each + more))
    return out
