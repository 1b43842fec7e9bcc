"""SimHash near-duplicates: pigeonhole blocks, verified Hamming distance, components.

Rows with one fingerprint are one class from the start.  Fingerprints at
most k bits apart agree in at least b - k of b blocks, so those that agree in
some choice of b - k blocks meet in a join on it and are then compared.
Where many different fingerprints share a block choice no pairs are formed:
each emits its one-bit variants of the rest, and two fingerprints are two
bits apart or less exactly if they share a variant, so linking each variant's
holders to the smallest of them joins all that belong together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkhist.llm._common import connected_components, fresh, materialize, sliced, split_join

#: Blocks of the 64 bits, of which all but two must agree.
BLOCKS = (13, 13, 13, 13, 12)
#: Fingerprints sharing a block choice beyond which variants replace pairs.
CROWD = 64
SEED = 42


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of word shingles: a bit is set if over half of the hashes have it."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h(b" ".join(words), SEED)
    hashes = np.fromiter(
        (h(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(shingle)))), np.uint64, len(words) - shingle + 1
    )
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * total > len(hashes)).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp): hash of the text and its fingerprint, of every row, as signed 64-bit integers."""
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(fps.view(np.int64))],
                names=["doc_id", "text_hash", "fp"],
            )

    return src.mapInArrow(run, f"doc_id {kind}, text_hash long, fp long")


def _masks() -> list[int]:
    """For each choice of all blocks but two, its bits as a signed mask."""
    edges = np.cumsum([0, *BLOCKS]).tolist()
    blocks = [((1 << BLOCKS[i]) - 1) << edges[i] for i in range(len(BLOCKS))]
    masks = [reduce(lambda a, b: a | b, c) for c in combinations(blocks, len(BLOCKS) - 2)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _bit(i: int) -> int:
    return -(1 << 63) if i == 63 else 1 << i


def link(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of `fp` at most two bits apart."""
    masks = _masks()
    keyed = distinct.select(
        "fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks))).alias("t", "k")
    )
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    sizes = materialize(sizes, "blocks")
    met = materialize(split_join(keyed, sizes, ["t", "k"], "n"), "met")
    few = met.where(F.col("n") <= crowd)
    left, right = few.select("t", "k", F.col("fp").alias("a")), few.select("t", "k", F.col("fp").alias("b"))
    pairs = left.join(right, ["t", "k"]).where(
        (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)
    )
    many = met.where(F.col("n") > crowd).withColumn("rest", F.element_at(
        F.array(*(F.lit(~m).cast("long") for m in masks)), F.col("t") + 1
    ))
    flips = F.array(F.lit(0).cast("long"), *(F.lit(_bit(i)).cast("long") for i in range(64)))
    spread = many.select(
        "fp", F.explode(F.filter(flips, lambda f: f.bitwiseAND(F.col("rest")) == f)).alias("flip")
    ).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    heads = materialize(
        spread.groupBy("variant").agg(F.min("fp").alias("head"), F.count("*").alias("n")).where("n > 1"), "variants"
    )
    crowded = split_join(spread, heads, ["variant"], "n").where("fp <> head").select(
        F.col("fp").alias("a"), F.col("head").alias("b")
    )
    return pairs.select("a", "b").unionByName(crowded).distinct()


def groups(rows: DataFrame, crowd: int = CROWD, more: DataFrame | None = None) -> DataFrame:
    """(fp, n, component, size) of every fingerprint in `rows` (fp).

    n rows have the fingerprint and `size` rows its component, which is named
    by one of its fingerprints.  `more` holds further links between
    fingerprints, (a, b).
    """
    classes = materialize(rows.groupBy("fp").agg(F.count("*").alias("n")), "classes")
    edges = link(classes.select("fp"), crowd)
    edges = edges if more is None else edges.unionByName(more.where("a <> b").select("a", "b"))
    found = materialize(connected_components(edges).select(F.col("node").alias("fp"), "component"), "groups")
    placed = materialize(
        classes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "placed"
    )
    sizes = placed.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("size"))
    return materialize(split_join(placed, materialize(sizes, "sizes"), ["component"], "m").drop("m"), "placed")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """Per row: doc_id, fp (signed), component_id, the smallest id reachable by links.

    Null and blank texts have fingerprint 0.  Repeated rows each get a line.
    A null id is never a component's id unless the component has no other.
    Other columns are not read; an empty table gives no line.
    """
    rows = materialize(fingerprints(docs, id_col, text_col).drop("text_hash"), "fingerprints")
    placed = groups(rows, crowd)
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    joined = materialize(placed.join(first, "fp"), "firsts")
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("m"))
    ids = split_join(joined, materialize(least, "least"), ["component"], "m").select("fp", "n", "component_id")
    return split_join(rows, materialize(ids, "component"), ["fp"], "n").select("doc_id", "fp", "component_id")


def simhash_digest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, fingerprint as 16 hexadecimal digits, component_id."""
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    crowd: int = CROWD,
    also: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """`docs` with exactly one row of each near-duplicate group: that of the smallest id, ids before null.

    Of several texts with that id the one with the smallest hash stays, of
    several rows with that text the smallest as written out.  So a repeated
    or missing id loses no group, and a group whose rows all lack an id keeps
    one row.  Columns may have any names and types; an empty table stays
    empty.  `also` gets (text_hash, text) and returns further links between
    text hashes, (a, b); see `shingles.link`.
    """
    rows = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    units = materialize(rows.groupBy("doc_id", "text_hash", "fp").agg(F.count("*").alias("copies")), "units")
    more = None
    if also is not None:
        text = F.col(text_col).cast("string")
        near = also(docs.select(F.xxhash64(text).alias("text_hash"), F.coalesce(text, F.lit("")).alias("text")))
        fp_of = materialize(units.select("text_hash", "fp").distinct(), "texts")
        for end in ("a", "b"):
            near = near.join(fp_of.select(F.col("text_hash").alias(end), F.col("fp").alias(f"fp_{end}")), end)
        more = materialize(near.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")).distinct(), "more")
    placed = groups(rows.select("fp"), crowd, more)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "copies")
    best = units.groupBy("fp").agg(F.min(order).alias("best"))
    keepers = placed.join(best, "fp").groupBy("component").agg(F.min("best").alias("best"))
    key, text_key, copies, nth = fresh(docs, "keep_id", "keep_hash", "keep_copies", "keep_nth")
    keepers = materialize(
        keepers.select(
            F.col("best.doc_id").alias(key), F.col("best.text_hash").alias(text_key), F.col("best.copies").alias(copies)
        ),
        "keepers",
    )
    (hashed,) = fresh(docs, "row_hash")
    left = docs.withColumn(hashed, F.xxhash64(F.col(text_col).cast("string")))
    met = left.join(keepers, left[id_col].eqNullSafe(keepers[key]) & (left[hashed] == keepers[text_key]))
    kept = met.where(F.col(copies) == 1).select(*docs.columns)
    if keepers.where(F.col(copies) > 1).limit(1).count():
        by = Window.partitionBy(key, text_key).orderBy(F.struct(*docs.columns).cast("string"))
        again = met.where(F.col(copies) > 1).withColumn(nth, F.row_number().over(by)).where(F.col(nth) == 1)
        kept = kept.unionByName(again.select(*docs.columns))
    return kept
