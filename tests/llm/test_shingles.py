import random

import corpus_pipeline
from weird import documents, keepers, lower, texts

from sparkhist.llm import shingles, simhash


def sets(text):
    words = lower(text).encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def edited(seed=0):
    """Texts and copies with words replaced: clusters, chains and pairs on both sides of 0.8."""
    rng = random.Random(seed)
    rows = []
    for _ in range(25):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([6, 30, 120, 300]))]
        for _ in range(12):
            rows.append((len(rows), " ".join(words)))
            if rng.random() < 0.5:
                words = list(words)
            for _ in range(rng.randrange(1 + len(words) // 40)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return rows


def near(s, fps, i, j):
    a, b = s[i], s[j]
    if (fps[i] ^ fps[j]).bit_count() <= 2:
        return True
    return bool(a) and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and (5 * len(a & b) >= 4 * len(a | b))


def test_near_copies_stage_brute_force(spark, sf):
    """The stage keeps exactly one row of each group of either link, whatever ids and columns there are."""
    rows = edited() + [(10_000 + i if i is not None else None, t) for i, t in texts()]
    rows += [(500, rows[3][1]), (500, "alpha beta gamma delta"), (500, "one two three four five"), (490, "one two three four five")]
    rows += [(None, "without any id here"), (None, "without any id here"), (None, rows[40][1])]
    s, fps = [sets(t) for _, t in rows], [simhash.fingerprint(t) for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if near(s, fps, i, j)]
    got = corpus_pipeline.drop_near_copies(spark, documents(spark, rows), sf).collect()
    want = keepers(rows, linked)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in want)
    left = {}
    for i, t in want:
        left.setdefault(i, []).append(t)
    for r in got:  # each kept row is one of its group's candidates, each group once
        mine = next(t for t in left[r.doc_id] if r.text in t)
        left[r.doc_id].remove(mine)
    assert not any(left.values())


def test_links_are_exact(spark):
    rows = [(i, t) for i, t in edited(1)]
    df = spark.createDataFrame(rows, "text_hash long, text string")
    found = {(min(r.a, r.b), max(r.a, r.b)) for r in shingles.link(df).collect()}
    s = [sets(t) for _, t in rows]
    assert found and all(5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b]) for a, b in found)
