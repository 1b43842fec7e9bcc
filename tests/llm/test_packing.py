import random
import zlib
from collections import defaultdict

import numpy as np
from weird import documents, texts

from sparkhist.llm import packing, tokens


def check(pieces, want):
    """Pieces rebuild every document, sequences have no gaps, and hardly any padding is needed."""
    sequences, docs = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        docs[p.doc_id].append(p)
        assert zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 and len(p.ids) == p.length > 0
    padding = total = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
        total += at
    assert padding == 0
    for key, ids in want.items():
        copies = sorted(tuple(x) for x in ids)
        mine = sorted(docs.pop(key), key=lambda p: (p.doc_tokens, p.start, p.ids))
        if len(copies) == 1:
            assert [i for p in mine for i in p.ids] == list(copies[0])
            assert all(p.doc_tokens == len(copies[0]) for p in mine)
        assert sum(p.length for p in mine) == sum(map(len, copies))
    assert not docs


def test_weird_rows(spark):
    want = defaultdict(list)
    for i, t in texts():
        want[i].append([*tokens.encoder().ids(t or ""), 1])
    check(packing.pack(documents(spark), with_ids=True).collect(), want)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: [[*tokens.encoder().ids(r.text), 1]] for r in docs.collect()}
    check(packing.pack(docs, with_ids=True).collect(), want)
    assert packing.pack(docs.limit(0)).count() == 0


def test_sum_of_squares_choice():
    p = packing.Packer(10, lambda w: None)
    rng = random.Random(0)
    for _ in range(500):
        r = rng.randint(1, 9)
        n = p.levels.astype(int).tolist()

        def squares(h, n=n, r=r):
            m = list(n)
            if h:
                m[h] -= 1
            if h + r < 10:
                m[h + r] += 1
            return sum(x * x for x in m)

        options = [h for h in range(10 - r + 1) if h == 0 or n[h]]
        h = p.choose(r)
        assert squares(h) == min(map(squares, options))
        p.add("d", bytes(4 * r))


def test_open_windows_stay_few():
    full = []
    p = packing.Packer(10, full.append, most_open=8)
    for _ in range(100):
        p.add("d", bytes(4 * 7))  # no two fit together
        assert p.open <= 8
    p.finish()
    assert sum(len(x[2]) // 4 for w in full for x in w) == 700
    assert all(n == 10 or n & (n - 1) == 0 for n in (sum(len(x[2]) // 4 for x in w) for w in full))
