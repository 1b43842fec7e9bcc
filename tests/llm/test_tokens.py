from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer
from weird import documents, texts

from sparkhist.llm import tokens

CASES = [
    "", " ", "  a  b", "a \n b\n\n c", "I'll don't we're they've 're", "x<|endoftext|>y <|endoftext|>", "日本 語  テ", "a  b  c",
    "a  <|endoftext|>!<|endoftext|><|endoftext|> !", "\n<|endoftext|>", "ab" * 300, "=" * 400 + " " + "-" * 300, "'s 'S 'r\n 'll'", "tab\tx y\n z ", "naïve — 😀😀 text", "1234 12a a12 !!! ?!",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.default_path())


def test_counts_equal_the_library(spark, sf, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + texts()
    got = tokens.token_counts(documents(spark, rows), with_prefixes=False).collect()
    want = Counter()
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 1024] += 1
    assert Counter(tuple(r) for r in got) == want


def test_every_prefix(library):
    c = tokens.prefix_counter()
    for text in CASES:
        counts = c.prefix_counts(text)
        assert len(counts) == len(text.encode()) + 1
        for i in range(len(text) + 1):
            n = len(library.encode(text[:i], add_special_tokens=False).ids)
            assert counts[len(text[:i].encode())] == n, (text, i)
        assert counts[-1] == c.count(text) == len(c.enc.ids(text))
        assert np.array_equal(np.cumsum(c.steps(text), dtype=np.int64), counts[1:])
        assert np.array_equal(tokens.read_prefixes(tokens.pack_prefixes(c.steps(text))), counts)


def test_ids_equal_the_library(library):
    e = tokens.encoder()
    for text in CASES:
        assert e.ids(text) == library.encode(text, add_special_tokens=False).ids


def test_budgets(library):
    text = "The quick brown fox jumps over the lazy dog, again and again."
    counts = tokens.prefix_counter().prefix_counts(text)
    for budget in (0, 3, 7, 100):
        cut = tokens.longest_within(counts, budget)
        fits = [i for i in range(len(text) + 1) if len(library.encode(text[:i]).ids) <= budget]
        assert cut == fits[-1]


def test_stored_prefixes_and_empty_table(spark):
    wide = np.array([1, -200, 70_000, 3])
    assert np.array_equal(tokens.read_prefixes(tokens.pack_prefixes(wide)), np.cumsum([0, *wide]))
    docs = spark.createDataFrame([(1, CASES[3]), (2, None)], "doc_id int, text string")
    for r in tokens.token_counts(docs).collect():
        counts = tokens.read_prefixes(r.prefix_counts)
        assert len(counts) == r.n_bytes + 1 and counts[-1] == r.n_tokens
        assert np.array_equal(counts, tokens.prefix_counter().prefix_counts(CASES[3] if r.doc_id == 1 else ""))
    assert tokens.token_counts(documents(spark, [])).count() == 0
