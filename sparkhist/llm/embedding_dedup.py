"""Near-duplicate embeddings: p-stable hashing in several tables, exact cosine checks.

A table hashes a normalised vector by `WIDTH`-quantised projections on
Gaussian directions (Datar, Immorlica, Indyk and Mirrokni, 2004).  Vectors
that share a bucket in a table, and their label, are candidates.  Most meet
by chance: they are told apart by 128 signs of further projections, and only
those with a partner of like signs are sent on with their vectors and
compared exactly.  Equal vectors are one class from the start; buckets are cut
into chunks of bounded size that are compared pair by pair of chunks, so no
bucket is one task's.  A pair counts in the first table where it meets; only
counts of links and one edge per vector leave a task, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkhist.llm._common import (
    by_group, connected_components, good_vectors, materialize, matrix, split_join, vector_column,
)

#: Tables, projections of each, and their width: at cosine 0.93 a pair is missed once in about 75.
TABLES, PROJECTIONS, WIDTH = 28, 12, 2.0
#: Signs of 128 that a pair may differ in: at cosine 0.93 fewer than one pair in ten million differs in more.
SIGNS, APART = 128, 36
#: Vectors of a chunk; two meet in a task.  Larger buckets are not looked through by signs.
CHUNK = 2048
#: Groups up to this size are compared by shifts of the stream, larger ones by a matrix; the results are the same.
SMALL = 24
SEED = 7


def _projections(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a = rng.standard_normal((dim, TABLES * PROJECTIONS))
    b = rng.uniform(0, WIDTH, TABLES * PROJECTIONS)
    mix = rng.integers(1, 1 << 62, PROJECTIONS, dtype=np.int64) | 1
    return a, b, mix


def bucket_codes(x: np.ndarray) -> np.ndarray:
    """A 32-bit bucket code of every row for each table; x needn't be normalised."""
    a, b, mix = _projections(x.shape[1])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    q = np.floor((x @ a + b) / WIDTH).astype(np.int64).reshape(len(x), TABLES, PROJECTIONS)
    with np.errstate(over="ignore"):
        return ((q * mix).sum(2) >> 24).astype(np.int32)


def sign_codes(x: np.ndarray) -> np.ndarray:
    """128 signs of Gaussian projections of every row, as two unsigned 64-bit integers."""
    a = np.random.default_rng(SEED + 1).standard_normal((x.shape[1], SIGNS))
    return np.packbits(x @ a > 0, axis=1).view(np.uint64)


def _like(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two sign codes, row by row, differ in at most APART places."""
    return np.bitwise_count(a ^ b).sum(-1) <= APART


def _partners(batches: Iterator[pa.RecordBatch], chunk: int, small: int) -> Iterator[pa.RecordBatch]:
    """Rows (t, cid) of a stream sorted by bucket `k` that have a partner of like signs in it."""
    for b in _batches_of_groups(batches, "k", chunk):
        k, m = b.column("k").to_numpy(), b.column("m").to_numpy()
        signs = np.stack([b.column(c).to_numpy().view(np.uint64) for c in ("s1", "s2")], 1)
        use = m > chunk
        for lag in range(1, small):
            i = np.flatnonzero((k[lag:] == k[:-lag]) & (m[lag:] <= small))
            if not len(i):
                break
            i = i[_like(signs[i], signs[i + lag])]
            use[i] = use[i + lag] = True
        for start in np.flatnonzero((m > small) & (m <= chunk) & np.concatenate([[True], k[1:] != k[:-1]])):
            mine = signs[start : start + m[start]]
            for i in range(0, len(mine), 256):
                near = _like(mine[i : i + 256, None], mine[None])
                use[start + i : start + i + len(near)] |= near.sum(1) > 1  # a row is like itself
        yield b.filter(pa.array(use)).select(["k", "t", "cid"])


def _batches_of_groups(batches: Iterator[pa.RecordBatch], key: str, chunk: int) -> Iterator[pa.RecordBatch]:
    """The rows of a sorted stream, cut between groups only where those have at most `chunk` rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k, m = b.column(key).to_numpy(), b.column("m").to_numpy()
        last = int(np.searchsorted(k, k[-1]))  # where the last group begins
        if m[-1] > chunk:
            last = b.num_rows  # it is not compared here
        elif last == 0 and not (held and held[-1].column(key)[-1].as_py() != k[0]):
            held.append(b)
            continue
        ready = pa.Table.from_batches([*held, b.slice(0, last)]).combine_chunks()
        held = [b.slice(last)] if last < b.num_rows else []
        yield from ready.to_batches()
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _near(x: np.ndarray, rows: np.ndarray, cols: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of rows and cols whose cosine is at least `least`, by a matrix; what is close to it is summed as in `_cosine`."""
    i, j = [], []
    for a in range(0, len(rows), 512):
        c = x[rows[a : a + 512]] @ x[cols].T
        p, q = np.nonzero(c >= least - 1e-9)
        p, q, c = rows[a + p], cols[q], c[p, q]
        close = np.flatnonzero(c < least + 1e-9)
        keep = np.ones(len(p), bool)
        keep[close] = _cosine(x[p[close]], x[q[close]]) >= least
        i.append(p[keep])
        j.append(q[keep])
    return np.concatenate(i), np.concatenate(j)


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, each summed in one order."""
    return np.add.reduce(np.ascontiguousarray(a * b), axis=1)


def _fresh(codes: np.ndarray, i: np.ndarray, j: np.ndarray, t: int) -> np.ndarray:
    """Pairs that met in no table before t."""
    return ~(codes[i, :t] == codes[j, :t]).any(1) if t else np.ones(len(i), bool)


def _links(batches: Iterator[pa.RecordBatch], least: float, most: int) -> Iterator[pa.RecordBatch]:
    """Edges and partial link counts of each group of a stream sorted by its keys."""
    keys = ["k", "lo", "hi"]
    small: list[pa.Table] = []
    waiting = 0

    def out(cid: np.ndarray, head: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(cid, pa.int64()), pa.array(head, pa.int64()), pa.array(links, pa.int64())],
            names=["cid", "head", "links"],
        )

    def load(t: pa.Table):
        x = matrix(t.column("vec"))
        return x / np.linalg.norm(x, axis=1, keepdims=True), matrix(t.column("codes"), "int32")

    def run_small() -> pa.RecordBatch:
        # All small groups of one dimension at once: row i meets row i + lag if both are of one group.
        t = pa.concat_tables(small)
        group = np.repeat(np.arange(len(small)), [len(s) for s in small])
        x, codes = load(t)
        cid, n, table = (t.column(c).to_numpy() for c in ("cid", "n", "t"))
        a, b, c = [], [], []
        for lag in range(1, most):
            i = np.flatnonzero(group[lag:] == group[:-lag])
            if not len(i):
                break
            i = i[_cosine(x[i], x[i + lag]) >= least]
            j = i + lag
            fresh = np.ones(len(i), bool)
            for k in np.unique(table[i]):
                if k:
                    m = table[i] == k
                    fresh[m] = ~(codes[i[m], :k] == codes[j[m], :k]).any(1)
            i, j = i[fresh], j[fresh]
            a += [cid[i], cid[j]]
            b += [np.minimum(cid[i], cid[j])] * 2
            c += [n[j], n[i]]
        small.clear()
        cat = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
        return out(cat(a), cat(b), cat(c))

    def run_large(t: pa.Table) -> pa.RecordBatch:
        x, codes = load(t)
        cid, n, side = (t.column(c).to_numpy() for c in ("cid", "n", "part"))
        table = int(t.column("t")[0].as_py())
        lo, hi = int(t.column("lo")[0].as_py()), int(t.column("hi")[0].as_py())
        rows = np.flatnonzero(side == lo)
        cols = rows if lo == hi else np.flatnonzero(side == hi)
        i, j = _near(x, rows, cols, least)
        fresh = _fresh(codes, i, j, table)
        if lo == hi:
            m = i != j
            i, j, fresh = i[m], j[m], fresh[m]
        else:
            i, j, fresh = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([fresh, fresh])
        links = np.bincount(i[fresh], n[j[fresh]], len(cid)).astype(np.int64)
        head = cid.copy()
        while True:  # smallest id reachable within the group
            low = head.copy()
            np.minimum.at(low, i, head[j])
            if (low == head).all():
                break
            head = low
        use = (links > 0) | (head != cid)
        return out(cid[use], head[use], links[use])

    dim = None
    for t in by_group(batches, keys):
        d = t.column("dim")[0].as_py()
        if small and (d != dim or waiting > 20_000):
            yield run_small()
            waiting = 0
        dim = d
        if len(t) <= most and t.column("lo")[0].as_py() == t.column("hi")[0].as_py():
            if len(t) > 1:
                small.append(t)
                waiting += len(t)
        else:
            yield run_large(t)
    if small:
        yield run_small()


def near_duplicates(
    vectors: DataFrame,
    least: float = 0.93,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str | None = "label",
) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept (vec_id = component_id).

    Rows link when their labels are equal and not null, their vectors have
    one length and a cosine of at least `least` and meet in a bucket; without
    ``label_col`` all have one label.  Rows with a null id, or a vector that
    is null, zero or holds null or non-finite numbers, link with nothing and
    are their own component.  An empty table gives no line.  Repeated rows are vectors of their own and link
    with one another.  Other columns are not read.
    """
    chunk, small = CHUNK, SMALL  # sent with the tasks
    label = F.xxhash64(F.col(label_col)) if label_col else F.lit(0).cast("long")
    known = F.col(label_col).isNotNull() if label_col else F.lit(True)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.when(known & F.col(id_col).isNotNull(), vector_column(vectors, vec_col)).alias("vec"),
        label.alias("label"),
    )
    kind = rows.schema["vec"].dataType.simpleString()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = pa.array(good_vectors(b.column("vec")))
            label = pc.if_else(ok, b.column("label"), pa.scalar(None, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("vec"), label], names=["vec_id", "vec", "label"])

    rows = rows.mapInArrow(check, f"vec_id long, vec {kind}, label long")
    # Classes are numbered by label and vector, as ids may repeat with other vectors.
    cid = F.when(F.col("label").isNotNull(), F.xxhash64("label", "vec")).alias("cid")
    rows = materialize(rows.select("vec_id", "label", "vec", cid), "rows")
    classes = (
        rows.where("cid IS NOT NULL").groupBy("cid")
        .agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.min("vec_id").alias("first"), F.count("*").alias("n"))
        .withColumn("dim", F.size("vec"))
    )
    names = ["cid", "n", "label", "dim", "first", "vec"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                part = b.filter(pa.array(dims == d))
                x = matrix(part.column("vec"))
                signs = sign_codes(x).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in names), pa.array(list(bucket_codes(x)), pa.list_(pa.int32())),
                        pa.array(np.ascontiguousarray(signs[:, 0])), pa.array(np.ascontiguousarray(signs[:, 1])),
                    ],
                    names=[*names, "codes", "s1", "s2"],
                )

    coded = materialize(
        classes.select(*names).mapInArrow(
            code, f"cid long, n long, label long, dim int, first long, vec {kind}, codes array<int>, s1 long, s2 long"
        ),
        "coded",
    )
    slots = coded.select("cid", "label", "dim", "s1", "s2", F.posexplode("codes").alias("t", "code")).select(
        F.xxhash64("label", "dim", "t", "code").alias("k"), "t", "cid", "s1", "s2"
    )
    sizes = materialize(slots.groupBy("k").agg(F.count("*").alias("m")).where("m > 1"), "buckets")
    met = split_join(slots, sizes, ["k"], "m")
    # Buckets above `chunk` pass through whole, so their rows may lie anywhere; others are sorted together.
    spread = F.when(F.col("m") > chunk, F.pmod("cid", F.ceil(F.col("m") / chunk))).otherwise(0)
    met = met.repartition("k", spread).sortWithinPartitions("k")
    slim = materialize(met.mapInArrow(lambda batches: _partners(batches, chunk, small), "k long, t int, cid long"), "partners")
    sizes = materialize(slim.groupBy("k").agg(F.count("*").alias("m")).where("m > 1"), "buckets")
    parts = F.ceil(F.col("m") / F.lit(chunk)).cast("int")
    met = split_join(slim, sizes, ["k"], "m").withColumn("parts", parts)
    met = met.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select(
        "cid", "k", "t", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi")
    )
    body = met.join(coded.select("cid", "n", "dim", "vec", "codes"), "cid")
    group = ["k", "lo", "hi"]
    body = body.repartition(*group).sortWithinPartitions("dim", *group, "cid")
    found = materialize(
        body.mapInArrow(lambda batches: _links(batches, least, small), "cid long, head long, links long"), "links"
    )
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    parent = connected_components(found.where("cid <> head").select("cid", "head"), "cid", "head")
    grouped = materialize(
        coded.select("cid", "n", "first").join(links, "cid", "left")
        .join(parent.withColumnRenamed("node", "cid"), "cid", "left")
        .select(
            "cid", "n", "first",
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component", "cid").alias("component"),
        ),
        "grouped",
    )
    least_id = materialize(
        grouped.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("m")), "least"
    )
    ids = split_join(grouped, least_id, ["component"], "m").select("cid", "n", "n_links", "component_id")
    whole = split_join(rows.where("cid IS NOT NULL").select("vec_id", "cid"), materialize(ids, "ids"), ["cid"], "n")
    apart = rows.where("cid IS NULL").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    out = whole.select("vec_id", "n_links", "component_id").unionByName(apart)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
