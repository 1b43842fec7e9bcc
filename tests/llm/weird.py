"""Rows that operators must not stumble over, and small brute-force helpers."""

from pyspark.sql import Row

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "length long, key string, dropped long, sequence_id long, size string, fp string, h1 long, copies int, "
    "text_hash string, lines string, pos int, keep_id int, KEEP_HASH int, keep_copies int, row_hash int, mix_id int, "
    "mix_hash int, mix_source int, mix_times int, mix_rows int, mix_n int, mix_text int, ld_id int, ld_text int, "
    "ld_runs int, _ld_id int, _ld_text int, _sd_id int, _mx_text int, tags map<string,int>"
)
LONG = "word " * 60_000 + "\n" + "x" * 50_000
LINE = "This line is shared by many documents of the corpus, see below"


def texts():
    """(doc_id, text): nulls, blanks, ties, repeated rows, long texts and shared lines."""
    rows = [
        (None, "a text without an id, but with words"), (None, None), (1, None), (2, ""), (3, " \t\n"), (4, LONG),
        (5, "same words here and nothing else"), (6, "same words here and nothing else"), (7, "SAME words here and nothing else"),
        (8, "repeated row"), (8, "repeated row"), (8, "another text of the same id"), (9, "naïve Ünïcode — 日本語 😀 text"),
        (10, "<|endoftext|> special <|endoftext|>"), (11, "\n\n" + LINE + "\n"),
    ]
    rows += [(i, f"{LINE}\nown line {i}\n  {LINE.upper()} \t") for i in range(20, 27)]
    rows += [(30, LINE), (30, LINE), (None, LINE)]
    return rows


def documents(spark, rows=None):
    """The rows with columns that have the names operators use inside."""
    made = []
    for n, (i, t) in enumerate(texts() if rows is None else rows):
        source = [None, "", "web", "book", "web"][n % 5]
        first = (i, t, None, source, None, 1, "k", 2, 3, "s", "f", 4, 5, "h", "l", *([7] * 19), {"b": 1, "a": 2})
        made.append(Row(*first))
    return spark.createDataFrame(made, SCHEMA).repartition(3)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def components(nodes, linked):
    """Smallest reachable node of each, by brute force."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def keepers(rows, linked):
    """Sorted (id, text) of the one row that stays of each group: the smallest id, ids before null.

    `linked` holds pairs of row numbers.  Of several texts with the smallest
    id any may stay, so the id alone is returned there.
    """
    comp = components(range(len(rows)), linked)
    best = {}
    for k, (i, t) in enumerate(rows):
        key = (i is None, i or 0)
        old = best.setdefault(comp[k], [key, {t}])
        if key < old[0]:
            best[comp[k]] = [key, {t}]
        elif key == old[0]:
            old[1].add(t)
    return [(None if none else i, texts) for (none, i), texts in best.values()]
