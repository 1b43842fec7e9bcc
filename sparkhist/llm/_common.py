"""Helpers shared by the operators: shared-folder tables, split joins, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most this many keys of a weighted table can each hold more than
#: 1/HOT_KEYS of its weight, which bounds what `split_join` broadcasts.
HOT_KEYS = 1024

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset (local tests) a temporary folder is made, which
    is refused on anything but a local master.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="sparkhist-")
        sc.setCheckpointDir(path)
        path = sc.getCheckpointDir()
    return path


def _sweep() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone; its folder is the cluster's to clean
            return


def watch(spark: SparkSession, path: str) -> None:
    """Delete `path` when the driver's Python ends."""
    if not _written:
        atexit.register(_sweep)
    _written.append((spark, path))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it again.

    Cuts lineage: a lost executor costs no recomputation of what is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkhist-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    watch(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table from `materialize` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for item in list(_written):
        if any(item[1].rsplit("/", 1)[-1] in f for f in df.inputFiles()[:1]):
            p = jvm.org.apache.hadoop.fs.Path(item[1])
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
            _written.remove(item)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """`names`, each lengthened until no column of `df` has it (letter case aside)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def split_join(big: DataFrame, keyed: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """Join `big` with `keyed` (one row per key) without piling a hot key on one task.

    ``weight`` is a column of `keyed`: how many rows of `big` have that key.
    Keys above 1/HOT_KEYS of the total weight, of which there are at most
    HOT_KEYS by counting, are broadcast; the others meet in a shuffle.
    `keyed` should be cheap to read twice (see `materialize`); `how` is
    ``inner`` or ``left``.  Keys that are null match nothing.
    """
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    limit = max(total // HOT_KEYS, 1)
    hot = F.broadcast(keyed.where(F.col(weight) > limit).withColumn("_hot", F.lit(True)))
    cold = keyed.where(F.col(weight) <= limit).withColumn("_hot", F.lit(False))
    if how == "inner":
        one = big.join(hot, keys, "inner")
        two = big.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, "inner")
        return one.unionByName(two).drop("_hot")
    probe = big.join(F.broadcast(hot), keys, "left")
    one = probe.where(F.col("_hot"))
    two = probe.where(F.col("_hot").isNull()).select(*big.columns).join(cold, keys, "left")
    return one.unionByName(two).drop("_hot")


def one_text_each(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per `key`, the one whose text has the smallest hash; rows of a hot key combine before they are shuffled."""
    row = F.struct(*[c for c in rows.columns if c != key])
    return rows.groupBy(key).agg(F.min_by(row, F.xxhash64(text)).alias("_row")).select(key, "_row.*")


def crc_mod(column: str | Column, modulus: int) -> Column:
    """crc32 of an id written as text, modulo `modulus`; null for a null id."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string").cast("binary")) % F.lit(modulus)


def crc_mod_py(value, modulus: int) -> int | None:
    """`crc_mod` of one Python value."""
    return None if value is None else zlib.crc32(str(value).encode()) % modulus


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node on an edge; component is the smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014), each
    written to the shared folder.  No adjacency list is gathered: a round is
    one grouped minimum and one join, the join split for hot nodes.  Null
    ends are dropped; self links keep their node.
    """
    e = (
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .where(F.col("u").isNotNull() & F.col("v").isNotNull())
        .distinct()
    )
    e = materialize(e, "edges")
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    current = materialize(
        e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star"
    )
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(
            both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "low"
        )
        large = split_join(both, low, ["u"], "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), "large")
        low2 = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "low")
        small = split_join(large, low2, ["u"], "n")
        small = (
            small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low2.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        after = materialize(small, "star")
        # A star forest: no node is both below another and above a third.
        tangled = after.select("v").distinct().join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        many = after.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
        done = tangled.limit(1).count() == 0 and many.limit(1).count() == 0
        for old in (low, large, low2, current):
            discard(old)
        current = after
        if done:
            break
    return nodes.join(current.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def trim() -> None:
    """Give freed memory back to the system, as workers stay when their task is done."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        return


def sliced(batches, rows: int = 1024):
    """Record batches of at most `rows` rows; memory is given back after each batch and at the end."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
        del b
        trim()


def by_group(batches, keys: list[str]):
    """Tables of the runs of equal `keys` in a sorted stream of record batches.

    Only the run that a batch ends in is held over, so memory is bounded by
    the largest group and one batch.
    """
    import numpy as np
    import pyarrow as pa

    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        if held is not None:
            t = pa.concat_tables([held, t])
        cols = [t.column(k).to_numpy() for k in keys]
        change = np.zeros(t.num_rows, bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        for i, j in zip(starts[:-1], starts[1:]):
            yield t.slice(i, j - i)
        held = t.slice(starts[-1]).combine_chunks()
    if held is not None:
        yield held


def matrix(column, dtype="float64"):
    """A list column of one length per row as a two-dimensional array."""
    import numpy as np

    c = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    flat = c.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype).reshape(len(c), -1) if len(c) else np.zeros((0, 0))


def good_vectors(column):
    """For each list of an Arrow column: True if it isn't null, empty or zero and holds finite numbers only."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)  # null components become NaN
    ends = np.cumsum(sizes)
    upto = lambda v: np.concatenate([[0], np.cumsum(v)])
    bad, full = upto(~np.isfinite(flat)), upto(flat != 0)
    return (bad[ends] == bad[ends - sizes]) & (full[ends] > full[ends - sizes])


def vector_column(df: DataFrame, name: str) -> Column:
    """The column as arrays of floats if it holds such, else of doubles."""
    kind = df.select(name).schema[0].dataType.simpleString()
    return F.col(name) if kind == "array<float>" else F.col(name).cast("array<double>")


def usable_vector(column: Column) -> Column:
    """True for vectors that are not null, zero or empty and hold finite numbers only."""
    c = column.cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.coalesce(c.isNotNull() & ~F.exists(c, bad) & F.exists(c, lambda x: x != 0), F.lit(False))
