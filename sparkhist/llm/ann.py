"""Nearest neighbours by inner product: probed lists, scanned a block of dimensions at a time.

Vectors get one more component that makes all of them equally long, so the
largest inner product is the least Euclidean distance.  A list is a coarse
centroid (its cell) and a residual centroid, so that a bounded sample can fit
as many lists as the table needs, about the square root of its rows; the
sample also tells how many of them a query must probe.  Every row is indexed.
Rows and queries are turned by one random rotation and scanned in column
blocks.  A candidate's partial distance over the first d of D dimensions
estimates the whole, and a hypothesis test abandons it once

    partial * D / d  >  (1 + EPSILON / sqrt(d))^2 * r^2,

r being the query's k-th best distance so far (ADSampling: Gao and Long,
2023), which tightens list by list: all lists of a cell that a query probes
are scanned by one task, its nearest first.  What survives all blocks is
scored on the original vectors by one sum of fixed order, so that equal
vectors have equal scores wherever they are met.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkhist.llm._common import by_group, good_vectors, materialize, matrix, vector_column

#: Rows the index is fitted on and those of them that set first thresholds, at most, and at most so many bytes of them.
SAMPLE, ANCHORS = 20_000, 4_000
SAMPLE_BYTES, ANCHOR_BYTES = 24_000_000, 4_000_000
#: Rows of a cell, and queries, that meet in one task.
ROWS, QUERIES = 4_096, 4_096
#: Recall the number of probed lists is chosen for, on the sample.
RECALL = 0.98
EPSILON = 2.1
BLOCK_DIMS = (16, 16, 32)
#: Pairs of a query and a row that are held at once; the share of them below which they are followed one by one.
PAIRS, DENSE = 1 << 19, 0.03


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products row by row, each summed in one order whatever stands beside it."""
    return np.add.reduce(np.ascontiguousarray(x * q), axis=1)


@dataclass
class Index:
    """What the tasks share: bounded by SAMPLE_BYTES."""

    longest: float  # the largest squared norm
    rotation: np.ndarray
    coarse: np.ndarray
    fine: np.ndarray
    probes: int
    anchors: np.ndarray  # original vectors
    anchor_ids: np.ndarray

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Rows of squared norm `longest`, rotated."""
        extra = np.sqrt(np.maximum(self.longest - (x * x).sum(1), 0.0))
        return np.column_stack([x, extra]) @ self.rotation

    def lift_query(self, q: np.ndarray) -> np.ndarray:
        return np.column_stack([q, np.zeros(len(q))]) @ self.rotation

    def place(self, lifted: np.ndarray) -> np.ndarray:
        """The list of each row: nearest cell, then nearest residual."""
        cell = _distances(lifted, self.coarse).argmin(1)
        return cell * len(self.fine) + _distances(lifted - self.coarse[cell], self.fine).argmin(1)

    def far(self, q: np.ndarray) -> np.ndarray:
        """Squared distance of each query to the centre of each list, but for what all lists share."""
        c, f = self.coarse, self.fine
        centre = ((c * c).sum(1)[:, None] + 2 * c @ f.T + (f * f).sum(1)[None, :])[None, :, :]
        return (centre - 2 * ((q @ c.T)[:, :, None] + (q @ f.T)[:, None, :])).reshape(len(q), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :]


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([_distances(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, v, k) for v in x.T], 1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return c


def fit(sample_ids: np.ndarray, sample: np.ndarray, rows: int, longest: float, k: int) -> Index:
    """Centroids, rotation and probes from `sample`, for a table of `rows` rows."""
    rng = np.random.default_rng(0)
    dim = sample.shape[1] + 1
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    anchors = min(ANCHORS, max(1, ANCHOR_BYTES // (8 * dim)))
    index = Index(longest, rotation, np.zeros((1, dim)), np.zeros((1, dim)), 1, sample[:anchors], sample_ids[:anchors])
    x = index.lift(sample)
    most = max(1, len(sample) // 16)
    cells = min(most, max(1, round(rows**0.25)))
    index.coarse = _kmeans(x, cells, rng)
    rest = x - index.coarse[_distances(x, index.coarse).argmin(1)]
    index.fine = _kmeans(rest, min(most, max(1, round(rows**0.5 / cells))), rng)
    near = index.place(x)
    test = np.arange(len(x))[:: max(1, len(x) // 256)][:256]
    q = index.lift_query(sample[test])
    got = sample[test] @ sample.T
    got[np.arange(len(test)), test] = -np.inf
    top = np.argsort(-got, axis=1)[:, : min(k, max(1, len(x) - 1))]
    need = []
    for i, row in enumerate(q):  # one query at a time, as lists may be many
        rank = np.empty(len(index.coarse) * len(index.fine), np.int64)
        rank[np.argsort(index.far(row[None])[0], kind="stable")] = np.arange(len(rank))
        need.append(rank[near[top[i]]])
    need = np.sort(np.concatenate(need))
    index.probes = int(need[min(len(need) - 1, int(np.ceil(RECALL * len(need))))]) + 1
    return index


def _best(i: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int, repeats: bool) -> np.ndarray:
    """Of entries (query i, row id, score), the k best of each query, an id once: positions, by query and rank."""
    order = np.lexsort((ids, -s, i))
    a, b = i[order], ids[order]
    if repeats:  # the best of each id stays
        by = np.lexsort((np.arange(len(a)), b, a))
        first = np.ones(len(a), bool)
        first[1:] = (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1])
        order = order[np.sort(by[first])]
        a = i[order]
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    starts = np.flatnonzero(new)
    rank = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
    return order[rank < k]


class _Cell:
    """Some rows of a cell and the queries that probe it."""

    def __init__(self, index: Index, k: int, queries: pa.Table, rows: pa.Table):
        self.index, self.k = index, k
        self.q, self.qid = matrix(queries.column("vec")), queries.column("vec_id").to_numpy()
        lists = rows.column("list").to_numpy()
        by = np.argsort(lists, kind="stable")
        self.x, self.xid = matrix(rows.column("vec"))[by], rows.column("vec_id").to_numpy()[by]
        self.repeats = len(np.unique(self.xid)) < len(self.xid)
        self.here, self.starts = np.unique(lists[by], return_index=True)
        self.starts = np.append(self.starts, len(by))
        self.lq, self.lx = index.lift_query(self.q), np.ascontiguousarray(index.lift(self.x))
        dim = self.lx.shape[1]
        self.edges = [0]
        for w in BLOCK_DIMS:
            if self.edges[-1] + w < dim:
                self.edges.append(self.edges[-1] + w)
        self.edges.append(dim)
        # Squared distance that a row must stay within: |q|^2 + longest - 2 * (k-th best score known).
        self.first = queries.column("floor").to_numpy()
        self.floor = self.first.copy()
        self.reach = (self.lq * self.lq).sum(1) + index.longest
        self.found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # query, row's id, score

    def scan(self, asked: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best rows of each query: its id, theirs, scores.  `asked`: each query's lists, nearest first."""
        sizes = np.diff(asked.offsets.to_numpy())
        flat = asked.flatten().to_numpy()
        owner = np.repeat(np.arange(len(sizes)), sizes)
        nth = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        for part in (nth == 0, nth > 0):  # nearest lists first, then list by list
            by = np.argsort(flat[part], kind="stable")
            which, who = flat[part][by], owner[part][by]
            at = np.searchsorted(which, self.here), np.searchsorted(which, self.here, "right")
            for n, (a, b) in enumerate(zip(*at)):
                lo, hi = self.starts[n], self.starts[n + 1]
                step = max(1, PAIRS // (hi - lo))
                for i in range(a, b, step):
                    self._list(who[i : min(i + step, b)], lo, hi)
        i, ids, s = self.found
        use = s >= self.first[i]
        return self.qid[i[use]], ids[use], s[use]

    def _limit(self, i: np.ndarray, d: int) -> np.ndarray:
        r2 = self.reach[i] - 2 * self.floor[i]
        dim = self.edges[-1]
        return r2 * (1 + EPSILON / np.sqrt(d)) ** 2 * d / dim if d < dim else r2 + 1e-9 * (1 + np.abs(r2))

    def _list(self, who: np.ndarray, lo: int, hi: int) -> None:
        # Block by block for whole tiles as long as many pairs are left, then for those that are.
        i = None
        for a, b in zip(self.edges, self.edges[1:]):
            if i is None:
                d = _distances(self.lq[who, a:b], self.lx[lo:hi, a:b])
                tile = d if not a else np.add(tile, d, out=tile)
                keep = tile <= self._limit(who, b)[:, None]
                if np.count_nonzero(keep) < DENSE * keep.size or b == self.edges[-1]:
                    i, j = np.nonzero(keep)
                    partial = tile[i, j]
                    i, j = who[i], j + lo
                continue
            d = self.lx[j, a:b] - self.lq[i, a:b]
            partial = partial + np.einsum("ij,ij->i", d, d)
            keep = partial <= self._limit(i, b)
            i, j, partial = i[keep], j[keep], partial[keep]
        own = self.xid[j] == self.qid[i]
        i, j = i[~own], j[~own]
        s = scores(self.x[j], self.q[i])
        use = s >= self.floor[i]
        if not use.any():
            return
        i, ids, s = i[use], self.xid[j[use]], s[use]
        touched = np.zeros(len(self.q), bool)
        touched[i] = True
        old = touched[self.found[0]]
        i, ids, s = (np.concatenate([v[old], new]) for v, new in zip(self.found, (i, ids, s)))
        best = _best(i, ids, s, self.k, self.repeats)
        i, ids, s = i[best], ids[best], s[best]
        last = np.append(np.flatnonzero(i[1:] != i[:-1]), len(i) - 1)
        full = np.diff(np.concatenate([[-1], last])) == self.k
        self.floor[i[last[full]]] = np.maximum(self.floor[i[last[full]]], s[last[full]])
        self.found = [np.concatenate([v[~old], new]) for v, new in zip(self.found, (i, ids, s))]


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """The k rows of largest inner product with each query row: query_id, rank, vec_id, score.

    `is_query` is a column over `vectors`; a query's candidates are all rows
    of other ids whose vectors have its length.  Vectors that are null, zero
    or hold null or non-finite numbers take no part, nor do rows without id;
    a query id that repeats is asked once, with the smallest of its vectors;
    a candidate id that repeats is found once, with its best score; equal scores
    go by id.  Other columns are not read.  An empty table gives no row.  One
    line per length of vectors, and one per list, come to the driver.
    """
    spark = vectors.sparkSession
    src = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"),
        vector_column(vectors, vec_col).alias("vec"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    kind = src.schema["vec"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(good_vectors(b.column("vec"))))
            if not b.num_rows:
                continue
            size = np.diff(b.column("vec").offsets.to_numpy())
            flat = np.asarray(b.column("vec").flatten().to_numpy(zero_copy_only=False), np.float64)
            norm = np.add.reduceat(flat * flat, np.cumsum(size) - size)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(size.astype(np.int32)), pa.array(norm)], names=[*b.schema.names, "dim", "norm"]
            )

    rows = materialize(
        src.mapInArrow(measure, f"vec_id long, vec {kind}, asks boolean, dim int, norm double"), "vectors"
    )
    found = [
        _search_dim(rows.where(F.col("dim") == r.dim), r.dim, r.n, float(r.longest), k)
        for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()
    ]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def _sample(rows: DataFrame, dim: int, n: int) -> pa.Table:
    """A bounded sample by hash of the id: most rows are dropped where they are read."""
    want = min(SAMPLE, max(1, SAMPLE_BYTES // (8 * (dim + 1))))
    h = F.xxhash64("vec_id")
    if n > 2 * want:
        part = int(2**40 * min(1.0, 1.5 * want / n))
        rows = rows.where(F.pmod(h, F.lit(2**40)) < part)
    return rows.orderBy(h, "vec_id", "vec").limit(want).select("vec_id", "vec").toArrow()


def _search_dim(rows: DataFrame, dim: int, n: int, longest: float, k: int) -> DataFrame:
    spark = rows.sparkSession
    got = _sample(rows, dim, n)
    index = fit(got.column("vec_id").to_numpy(), matrix(got.column("vec")), n, longest, k)
    kind = rows.schema["vec"].dataType.simpleString()
    per_cell = len(index.fine)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = index.place(index.lift(matrix(b.column("vec"))))
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), b.column("vec"), pa.array(near.astype(np.int32))], names=["vec_id", "vec", "list"]
                )

    listed = materialize(rows.select("vec_id", "vec").mapInArrow(assign, f"vec_id long, vec {kind}, list int"), "lists")
    size = {r.list: r.n for r in listed.groupBy("list").agg(F.count("*").alias("n")).collect()}
    sizes = np.array([size.get(i, 0) for i in range(len(index.coarse) * per_cell)])
    filled = np.flatnonzero(sizes)

    by_id = np.argsort(index.anchor_ids, kind="stable")
    anchor_ids, anchors = index.anchor_ids[by_id], index.anchors[by_id]
    repeated = len(np.unique(anchor_ids)) < len(anchor_ids)

    def meet_anchors(q: np.ndarray, own: int, rough: np.ndarray):
        """The k best anchors of one query by exact scores: ids and scores."""
        rough = np.where(anchor_ids == own, -np.inf, rough)
        some = np.arange(len(rough))
        if not repeated and len(rough) > k:
            cut = np.partition(rough, -k)[-k]
            some = np.flatnonzero(rough >= cut - 1e-9 * (1 + abs(cut)) if cut > -np.inf else rough > -np.inf)
        some = some[rough[some] > -np.inf]
        s = scores(anchors[some], q[None])
        best = _best(np.zeros(len(some), np.int64), anchor_ids[some], s, k, repeated)
        return anchor_ids[some][best], s[best]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                q, ids = matrix(part.column("vec")), part.column("vec_id").to_numpy()
                met = [meet_anchors(v, i, r) for v, i, r in zip(q, ids, q @ anchors.T)]
                out: dict[str, list] = {"row": [], "cell": [], "lists": []}
                for n, row in enumerate(index.lift_query(q)):
                    order = filled[np.argsort(index.far(row[None])[0][filled], kind="stable")]
                    enough = int((np.cumsum(sizes[order]) < 10 * k + 1).sum()) + 1
                    lists = order[: max(index.probes, enough)]
                    cells = lists // per_cell
                    by = np.argsort(cells, kind="stable")
                    cuts = np.flatnonzero(np.diff(cells[by])) + 1
                    groups = np.split(lists[by], cuts)
                    out["row"] += [n] * len(groups)
                    out["cell"] += [int(g[0] // per_cell) for g in groups]
                    out["lists"] += [g.astype(np.int32) for g in groups]
                at = np.array(out["row"])
                floor = np.array([m[1][-1] if len(m[1]) == k else -1e300 for m in met])
                first = np.concatenate([[True], at[1:] != at[:-1]])  # the anchors are told once
                none = np.zeros(0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[at]), part.column("vec").take(pa.array(at)), pa.array(floor[at]),
                        pa.array(np.array(out["cell"], np.int32)), pa.array(out["lists"], pa.list_(pa.int32())),
                        pa.array([met[i][0] if f else none for i, f in zip(at, first)], pa.list_(pa.int64())),
                        pa.array([met[i][1] if f else none for i, f in zip(at, first)], pa.list_(pa.float64())),
                    ],
                    names=["vec_id", "vec", "floor", "cell", "lists", "met", "met_score"],
                )

    queries = rows.where("asks").groupBy("vec_id").agg(F.min("vec").alias("vec")).mapInArrow(
        ask, f"vec_id long, vec {kind}, floor double, cell int, lists array<int>, met array<long>, met_score array<double>"
    )
    queries = materialize(queries, "queries")
    asked = {r.cell: r.nq for r in queries.groupBy("cell").agg(F.count("*").alias("nq")).collect()}
    cell_size = sizes.reshape(-1, per_cell).sum(1)
    cut = spark.createDataFrame(
        [(i, -(-int(cell_size[i]) // ROWS), -(-nq // QUERIES)) for i, nq in sorted(asked.items())] or [(-1, 1, 1)],
        "cell int, parts int, rounds int",
    )  # one row per cell
    parts = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    rounds = F.pmod(F.xxhash64("vec_id"), F.col("rounds")).cast("int")
    none = F.array().cast("array<int>")
    data = listed.withColumn("cell", F.expr(f"list div {per_cell}").cast("int")).join(F.broadcast(cut), "cell").select(
        "cell", parts.alias("part"), F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)).alias("round"),
        F.lit(1).alias("kind"), "vec_id", "vec", F.lit(0.0).alias("floor"), "list", none.alias("lists"),
    )
    questions = queries.join(F.broadcast(cut), "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), rounds.alias("round"),
        F.lit(0).alias("kind"), "vec_id", "vec", "floor", F.lit(0).alias("list"), "lists",
    )
    group = ["cell", "part", "round"]
    stream = data.unionByName(questions).repartition(*group).sortWithinPartitions(*group, "kind")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, group):
            asks = int((t.column("kind").to_numpy() == 0).sum())
            if asks and asks < len(t):
                ask, have = t.slice(0, asks).combine_chunks(), t.slice(asks)
                a, b, c = _Cell(index, k, ask, have).scan(ask.column("lists").chunk(0))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], names=["query_id", "vec_id", "score"])

    # The anchors are rows like others, so the first threshold comes with the rows that set it.
    met = queries.select(
        F.col("vec_id").alias("query_id"), F.explode(F.arrays_zip("met", "met_score")).alias("m")
    ).select("query_id", F.col("m.met").alias("vec_id"), F.col("m.met_score").alias("score"))
    both = stream.mapInArrow(scan, "query_id long, vec_id long, score double").unionByName(met)
    return both.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def ann_digest(vectors: DataFrame) -> DataFrame:
    """Every 20th vector's 20 nearest by inner product."""
    return search(vectors, F.col("vec_id") % 20 == 0)
