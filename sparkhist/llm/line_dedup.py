"""Removing lines that many documents share, with DataFrame functions only.

Line hashes are range-partitioned together with their document, each range
sorted by hash, document and position, and streamed: the first row of a
(hash, document) run is that document's first occurrence.  Counting those per
hash, combined before the shuffle, finds the shared lines.  What comes back
per document is not text but a compressed keep bitmap, run lengths of kept
and dropped lines in turn, which is then applied where the text is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkhist.llm._common import fresh, materialize, split_join

#: The ASCII white space that is stripped from a line's ends.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other letter kept."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def split_lines(text: Column) -> Column:
    """The lines of a whole text; null and empty text are one empty line."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def runs_of(dropped: Column, n: Column) -> Column:
    """Keep bitmap as run lengths: kept, dropped, kept, ... of n lines in all.

    `dropped` holds sorted distinct positions; every second run has length 1
    or more, so neighbours in a row are parted by runs of 0 kept lines.
    """
    gap = lambda p, i: p - F.when(i == 0, F.lit(-1)).otherwise(F.get(dropped, i - 1)) - 1
    pairs = F.flatten(F.transform(dropped, lambda p, i: F.array(gap(p, i), F.lit(1))))
    return F.concat(pairs, F.array(n - 1 - F.element_at(dropped, -1)))


def apply_runs(lines: Column, runs: Column) -> Column:
    """The lines whose bit is set; `runs` as from `runs_of`."""
    bits = F.array_join(F.transform(runs, lambda r, i: F.repeat(F.when(i % 2 == 0, F.lit("1")).otherwise(F.lit("0")), r)), "")
    mask = bits.cast("binary")
    return F.filter(
        F.transform(lines, lambda x, i: F.struct(x.alias("x"), (F.substring(mask, i + 1, 1) == F.lit(b"1")).alias("k"))),
        lambda s: s["k"],
    )["x"]


def keep_bitmaps(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, text_hash, n_lines, n_dropped, keep_runs) of the documents that lose lines.

    ``keep_runs`` is the compressed keep bitmap: run lengths of kept and
    dropped lines in turn, see `runs_of`.  No text is returned.

    A line's key is the line stripped of ASCII blanks with A-Z lower-cased.
    Keys of at least `min_chars` code points in at least `min_docs` documents
    lose all their lines but those in the largest id that has them.  Rows of
    one id are one document; rows without id together are one, which counts
    as smaller than all others.
    """
    text = F.col(text_col).cast("string")
    # Only names of this function's own from here on, whatever other columns `docs` has.
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).where(F.char_length("text") >= min_chars)
    rows = rows.withColumn("lines", split_lines(F.col("text")))
    lines = rows.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.size("lines").alias("n"), F.posexplode("lines")
    )
    lines = lines.where(F.char_length("col") >= min_chars)
    lines = lines.withColumn("key", F.trim(F.col("col"), F.lit(BLANK))).where(F.char_length("key") >= min_chars)
    lines = lines.withColumn("key", ascii_lower(F.col("key")))
    lines = materialize(
        lines.select(
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit(1), "key").alias("h2"),
            "doc_id",
            "text_hash",
            "n",
            F.col("pos").cast("int").alias("pos"),
        ),
        "lines",
    )
    ranged = lines.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    firsts = ranged.withColumn(
        "nth", F.row_number().over(Window.partitionBy("h1", "h2", "doc_id").orderBy("pos"))
    )
    # One range holds all of a document's rows of a key, so both counts are local before they are combined.
    shared = firsts.groupBy("h1", "h2").agg(
        F.count_if(F.col("nth") == 1).alias("n_docs"), F.count("*").alias("n_lines"), F.max("doc_id").alias("last_id")
    )
    shared = materialize(shared.where(F.col("n_docs") >= min_docs).drop("n_docs"), "shared")
    dropped = split_join(lines, shared, ["h1", "h2"], "n_lines").where(~F.col("doc_id").eqNullSafe(F.col("last_id")))
    found = dropped.groupBy("doc_id", "text_hash").agg(
        F.max("n").alias("n"), F.array_sort(F.collect_set("pos")).alias("dropped")
    )
    return found.select(
        "doc_id",
        "text_hash",
        F.col("n").alias("n_lines"),
        F.size("dropped").alias("n_dropped"),
        runs_of(F.col("dropped"), F.col("n")).alias("keep_runs"),
    )


def dedup_lines(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`docs` with `text_col` freed of shared lines, plus n_lines, n_dropped, keep_runs in a struct ``line_dedup``.

    All rows and columns stay; texts that lose nothing stay as they are
    (null too, which counts as one empty line).  Repeated rows each stay and
    lose the same lines; an empty table stays empty.  See `keep_bitmaps` for
    what is dropped.  Columns that `docs` has besides may have any name but
    ``line_dedup``.
    """
    k_id, k_hash, k_dropped, k_runs, text_hash = fresh(docs, "ld_id", "ld_hash", "ld_dropped", "ld_runs", "ld_text")
    bitmaps = keep_bitmaps(docs, min_chars, min_docs, id_col, text_col).select(
        F.col("doc_id").alias(k_id), F.col("text_hash").alias(k_hash),
        F.col("n_dropped").alias(k_dropped), F.col("keep_runs").alias(k_runs),
    )
    keyed = docs.withColumn(text_hash, F.xxhash64(F.col(text_col).cast("string")))
    joined = keyed.join(
        bitmaps, keyed[id_col].eqNullSafe(bitmaps[k_id]) & (keyed[text_hash] == bitmaps[k_hash]), "left"
    )
    lines = split_lines(F.col(text_col))
    n = F.size(lines)
    out = joined.withColumn(
        "line_dedup",
        F.struct(
            n.cast("long").alias("n_lines"),
            F.coalesce(F.col(k_dropped), F.lit(0)).cast("long").alias("n_dropped"),
            F.coalesce(F.col(k_runs), F.array(n)).alias("keep_runs"),
        ),
    )
    text = F.when(F.col(k_runs).isNull(), F.col(text_col)).otherwise(
        F.array_join(apply_runs(lines, F.col("line_dedup.keep_runs")), "\n")
    )
    return out.withColumn(text_col, text).drop(k_id, k_hash, k_dropped, k_runs, text_hash)


def line_digest(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Per row: doc_id, n_lines (before dropping), n_dropped, kept_sha256 of the lines that stay.

    A null or empty text is one empty line; repeated rows each get a line,
    null ids too; other columns are not read; an empty table gives none.
    """
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return dedup_lines(slim, min_chars, min_docs).select(
        "doc_id",
        "line_dedup.n_lines",
        "line_dedup.n_dropped",
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS last_id FROM k WHERE length(key) >= 40
      GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.last_id AS gone
      FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
