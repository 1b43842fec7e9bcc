import hashlib
from collections import Counter, defaultdict

import duckdb
from weird import LINE, documents, lower, texts

from sparkhist.llm import line_dedup

BLANK = " \t\n\x0b\x0c\r"


def brute(rows):
    least = -(10**9)  # rows without id are one document below all others
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = lower(line.strip(BLANK))
            if len(k) >= 40:
                holders[k].add(least if i is None else i)
    out = Counter()
    for i, t in rows:
        kept, gone = [], 0
        lines = (t or "").split("\n")
        for line in lines:
            h = holders.get(lower(line.strip(BLANK)), ())
            if len(h) >= 5 and (least if i is None else i) != max(h):
                gone += 1
            else:
                kept.append(line)
        out[i, len(lines), gone, hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


def test_brute_force(spark):
    got = line_dedup.line_digest(documents(spark))
    assert Counter(tuple(r) for r in got.collect()) == brute(texts())


def test_sql(spark, sf):
    got = sorted(tuple(r) for r in line_dedup.line_digest(spark.read.parquet(f"{sf}/documents.parquet")).collect())
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert got == sorted(duck.execute(line_dedup.SQL).fetchall())


def test_texts_columns_and_bitmaps(spark):
    docs = documents(spark)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "line_dedup"] and out.count() == docs.count()
    rows = {r.doc_id: r for r in out.where("doc_id BETWEEN 20 AND 26").collect()}
    assert rows[20].text == "own line 20" and rows[20].line_dedup.keep_runs == [0, 1, 1, 1, 0]
    assert out.where("doc_id = 30").first().text == LINE


def test_empty_table_and_plan(spark):
    docs = documents(spark, [])
    assert line_dedup.line_digest(docs).count() == 0
    plan = line_dedup.line_digest(documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_many_dropped_lines(spark):
    shared = [f"a shared line of at least forty code points, number {i}" for i in range(300)]
    rows = [(d, "\n".join(x for i, x in enumerate(shared) if i % 7 != d)) for d in range(6)]
    got = line_dedup.line_digest(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(tuple(r) for r in got.collect()) == brute(rows)
