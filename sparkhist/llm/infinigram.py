"""Language-model scores from suffix arrays: n-grams of unbounded length.

The training texts are dealt into shards of bounded size.  A shard is written
to the shared folder as its tokens in reverse order and their suffix array,
so that the contexts of all its tokens stand sorted, last word first.  For
every token of a text, binary search in each shard finds the longest context
that occurs before some training token; occurrences in all shards that have
a context of that length are summed, and

    P(w | context) = (count(context, w) + MASS * base(w)) / (count(context) + MASS)

with the add-one unigram as base, which sums to one over the vocabulary and
one unknown word.  Longest matches skip ahead by comparing prefix hashes, so
copies of long texts cost no more than others (Liu et al., 2024, use suffix
arrays in this way).  As each text visits each shard, `score` does so for
one shard only; larger corpora are counted by `grams`, with equal results.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkhist.llm import _common
from sparkhist.llm._common import crc_mod, shared_dir, trim

#: Bytes of text in a shard, about; tokens that are scored against it at once; those of them numbered at once.
SHARD_BYTES, BATCH_TOKENS, PART_TOKENS = 60_000_000, 6_000_000, 2_000_000
#: Pseudo-count of the base distribution.
MASS = 1.0
#: Hash of the end of a text; no word contains a space.
END = b" end"
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Elements handled at once where that saves memory.
STEP = 1 << 20
#: Matches from this length on are confirmed by a second hash: repetitive texts can collide by the first one
#: from about a thousand tokens on.
SURE = 256
#: Intervals up to this size are counted entry by entry.
FEW = 8


def word_hashes(text: str | None) -> array:
    """64-bit hashes of the words of a text, A-Z lower-cased, and of its end."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    out = array("Q", map(h, (text or "").encode().lower().split()))
    out.append(h(END))
    return out


def reverse_texts(hashes: list[array]) -> tuple[np.ndarray, np.ndarray]:
    """All texts back to front, each closed by a separator: hashes (0 there) and their distances to the separator."""
    sizes = np.fromiter((len(h) + 1 for h in hashes), np.int64, len(hashes))
    total = int(sizes.sum())
    flat = np.zeros(total, np.uint64)
    at = 0
    for h in hashes:
        flat[at : at + len(h)] = np.frombuffer(h, np.uint64)[::-1]
        at += len(h) + 1
    ends = np.cumsum(sizes) - 1
    rest = np.repeat(ends, sizes) - np.arange(total)
    return flat, rest


def suffix_array(tokens: np.ndarray, bits: int, k: int) -> np.ndarray:
    """Positions sorted by what follows; `tokens` below 2^bits, separators all different.

    k tokens are sorted at once, then ties alone by the rank k, 2k, 4k, ...
    further on.
    """
    n = len(tokens)
    key = packed(tokens, np.arange(n), bits, k)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    del key, sorted_key
    starts = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order] = starts
    rank[n] = -1
    step = k
    while True:
        tied = np.zeros(n, bool)
        tied[:-1] |= ~new[1:]
        tied[1:] |= ~new[1:]
        where = np.flatnonzero(tied)
        if not len(where):
            return order.astype(np.int32)
        pos = order[where]
        group = rank[pos]
        follow = rank[np.minimum(pos + step, n)]
        by = np.lexsort((follow, group))
        pos, group, follow = pos[by], group[by], follow[by]
        order[where] = pos
        fresh = np.ones(len(pos), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
        new[where] = fresh
        rank[pos] = np.maximum.accumulate(np.where(fresh, where, 0))
        step *= 2


def packed(tokens: np.ndarray, at: np.ndarray, bits: int, k: int) -> np.ndarray:
    """k tokens from each position in one integer; 0 stands for what is past the end."""
    n = len(tokens)
    key = np.zeros(len(at), np.int64)
    for i in range(k):
        p = at + i
        t = tokens[np.minimum(p, n - 1)].astype(np.int64)
        key = (key << bits) | np.where(p < n, t, 0)
    return key


class Shard:
    """Tokens back to front, their suffix array, and vocabulary of a part of the corpus."""

    def __init__(self, vocabulary: np.ndarray, tokens: np.ndarray, order: np.ndarray):
        self.vocabulary, self.tokens, self.order = vocabulary, tokens, order
        self.bits = max(1, int(tokens.max()).bit_length()) if len(tokens) else 1
        self.k = max(1, min(3, 63 // self.bits))
        self.counts = np.bincount(tokens, minlength=len(vocabulary) + 1)[1 : len(vocabulary) + 1]

    @classmethod
    def build(cls, hashes: list[array]) -> Shard:
        """The shard of some texts; empties the list, which may be most of the memory."""
        flat, rest = reverse_texts(hashes)
        hashes.clear()
        words = rest > 0
        del rest
        vocabulary, ids = np.unique(flat[words], return_inverse=True)
        tokens = np.empty(len(flat), np.int32)
        tokens[words] = ids + 1
        # Separators differ from all else, so that no match runs across texts.
        tokens[~words] = len(vocabulary) + 1 + np.arange(int((~words).sum()))
        del flat, ids
        out = cls(vocabulary, tokens, np.zeros(0, np.int32))
        out.order = suffix_array(tokens, out.bits, out.k)
        return out

    def open(self) -> Shard:
        """Keys and prefix hashes that searching needs."""
        self.key = np.empty(len(self.order), np.int64)
        for i in range(0, len(self.order), STEP):
            self.key[i : i + STEP] = packed(self.tokens, self.order[i : i + STEP].astype(np.int64), self.bits, self.k)
        extra = int(self.tokens.max()) - len(self.vocabulary) if len(self.tokens) else 0
        odd = np.arange(1, extra + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        table = np.concatenate([np.zeros(1, np.uint64), self.vocabulary, odd])
        self.prefix = prefix_hashes(self.tokens, table)
        return self

    @cached_property
    def second(self) -> np.ndarray:
        """Prefix hashes modulo the prime; separators, which no match runs across, count nothing."""
        table = np.zeros(int(self.tokens.max()) + 1, np.uint64)
        table[1 : len(self.vocabulary) + 1] = self.vocabulary
        return prime_hashes(self.tokens, table)


def _powers(n: int, first: np.uint64) -> np.ndarray:
    out = np.ones(n, np.uint64)
    with np.errstate(over="ignore"):
        out[1:] = np.multiply.accumulate(np.full(n - 1, first, np.uint64))
    return out


_LOW = _powers(1 << 14, _B)
with np.errstate(over="ignore"):
    _HIGH = _powers(1 << 17, _LOW[-1] * _B)


def power(i: np.ndarray) -> np.ndarray:
    """B^i modulo 2^64, from two small tables."""
    with np.errstate(over="ignore"):
        return _HIGH[i >> 14] * _LOW[i & 16383]


#: A second hash, modulo a prime, tells apart what the first one can't: texts may be built to collide modulo 2^64.
_P, _B2 = np.int64(2**31 - 1), 1_103_515_245


def _prime_powers(n: int, first: int) -> np.ndarray:
    out = [1]
    for _ in range(n - 1):
        out.append(out[-1] * first % int(_P))
    return np.array(out, np.int64)


_LOW2 = _prime_powers(1 << 14, _B2)
_HIGH2 = _prime_powers(1 << 17, int(_LOW2[-1]) * _B2 % int(_P))


def prime_power(i: np.ndarray) -> np.ndarray:
    return _HIGH2[i >> 14] * _LOW2[i & 16383] % _P


def prime_hashes(values: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """`prefix_hashes` modulo the prime."""
    n = len(values)
    out = np.zeros(n + 1, np.int32)
    for i in range(0, n, STEP):
        v = values[i : i + STEP]
        v = ((v if table is None else table[v]) % np.uint64(_P)).astype(np.int64)
        part = np.cumsum(v * prime_power(np.arange(i, i + len(v))) % _P)
        out[i + 1 : i + 1 + len(v)] = (part + out[i]) % _P
    return out


def prefix_hashes(values: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """H[i] = sum of values[t] * B^t for t < i, modulo 2^64; values are looked up in `table` if there is one."""
    n = len(values)
    out = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, n, STEP):
            v = values[i : i + STEP]
            part = np.cumsum((v if table is None else table[v]) * power(np.arange(i, i + len(v))))
            out[i + 1 : i + 1 + len(v)] = part + out[i]
    return out


class Texts:
    """Texts to be scored, and how their words are numbered in a shard."""

    def __init__(self, hashes: list[array]):
        flat, rest = reverse_texts(hashes)
        self.rest = rest.astype(np.int32)
        del rest
        token = self.rest > 0
        self.prefix = prefix_hashes(flat)
        self.words, inverse = np.unique(flat[token], return_inverse=True)
        self.word_of = np.full(len(flat), -1, np.int32)
        self.word_of[token] = inverse
        self.unigrams = np.zeros(len(self.words), np.int64)

    @cached_property
    def second(self) -> np.ndarray:
        return prime_hashes(self.word_of, np.append(self.words, np.uint64(0)))  # -1, a separator, is the last

    def meet(self, s: Shard) -> None:
        """Number the words as the shard does and add up its counts of them."""
        pos = np.searchsorted(s.vocabulary, self.words)
        pos_in = np.minimum(pos, max(0, len(s.vocabulary) - 1))
        known = s.vocabulary[pos_in] == self.words if len(s.vocabulary) else np.zeros(len(self.words), bool)
        self.unigrams[known] += s.counts[pos_in[known]]
        ids = np.zeros(len(self.words) + 1, np.int32)  # 0: not there; the last is for separators
        ids[:-1][known] = pos_in[known] + 1
        self.ids = ids[self.word_of]

    def range(self, s: Shard, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of suffixes that start with the n <= k tokens from each position; empty if one is unknown."""
        key, ok = np.zeros(len(at), np.int64), np.ones(len(at), bool)
        last = len(self.ids) - 1
        for i in range(n):
            t = self.ids[np.minimum(at + i, last)]
            ok &= t > 0
            key = (key << s.bits) | t
        shift = s.bits * (s.k - n)
        lo = np.searchsorted(s.key, key << shift)
        hi = np.searchsorted(s.key, (key + 1) << shift)
        hi[~ok] = lo[~ok]
        return lo, hi

    def common(self, s: Shard, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length, up to `most`, of what text positions a and shard positions b have in common."""
        most = np.minimum(most, len(s.tokens) - b)
        out = self._common(s, a, b, most, False)
        # If any comparison on the way was wrong, what was found isn't equal by the second hash either.
        wrong = np.flatnonzero(out >= SURE)
        if len(wrong):
            wrong = wrong[~self._same(s, a[wrong], b[wrong], out[wrong])]
        if len(wrong):
            out[wrong] = self._common(s, a[wrong], b[wrong], most[wrong], True)
        return out

    def _same(self, s: Shard, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether n tokens from each a and b agree, by the second hash."""
        x = (self.second[a + n].astype(np.int64) - self.second[a]) % _P * prime_power(b) % _P
        y = (s.second[b + n].astype(np.int64) - s.second[b]) % _P * prime_power(a) % _P
        return x == y

    def _common(self, s: Shard, a: np.ndarray, b: np.ndarray, most: np.ndarray, both: bool) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        pa_, pb = power(a), power(b)
        ha, hb = self.prefix[a], s.prefix[b]
        bit = 1 << max(0, int(most.max(initial=0)).bit_length() - 1)
        with np.errstate(over="ignore"):
            while bit:
                to = out + bit
                fits = to <= most
                t = np.where(fits, to, 0)
                same = (self.prefix[a + t] - ha) * pb == (s.prefix[b + t] - hb) * pa_
                if both:
                    same &= self._same(s, a, b, t)
                out = np.where(fits & same, to, out)
                bit >>= 1
        return out

    def edge(self, s: Shard, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: np.ndarray, upper: bool) -> np.ndarray:
        """Where in [lo, hi) suffixes begin to be no less (`upper`: greater) than `length` tokens of each text."""
        lo, hi = lo.copy(), hi.copy()
        live = np.flatnonzero(lo < hi)
        last = len(s.tokens) - 1
        while len(live):
            m = (lo[live] + hi[live]) >> 1
            p, a = s.order[m].astype(np.int64), at[live]
            d = self.common(s, a, p, length[live])
            whole = d == length[live]
            less = s.tokens[np.minimum(p + d, last)] < self.ids[np.minimum(a + d, len(self.ids) - 1)]
            right = np.where(whole, upper, less)
            lo[live] = np.where(right, m + 1, lo[live])
            hi[live] = np.where(right, hi[live], m)
            live = live[lo[live] < hi[live]]
        return lo

    def refine(self, s: Shard, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: np.ndarray, most: np.ndarray):
        """Follow each text from position `at` beyond the `length` tokens that [lo, hi) shares with it, up to `most`.

        Returns the interval of those that share the most tokens, and how many.
        """
        lo, hi, length = lo.copy(), hi.copy(), length.copy()
        go = np.flatnonzero((length < most) & (hi > lo))
        one = go[hi[go] - lo[go] == 1]
        length[one] = self.common(s, at[one], s.order[lo[one]].astype(np.int64), most[one])
        many = go[hi[go] - lo[go] > 1]
        if len(many):
            a, l, h, m = at[many], lo[many], hi[many], most[many]
            # The best match lies beside the place where the text would be inserted.
            p = self.edge(s, a, l, h, m, False)
            right = self.common(s, a, s.order[np.minimum(p, h - 1)].astype(np.int64), m)
            left = self.common(s, a, s.order[np.maximum(p - 1, l)].astype(np.int64), m)
            d = np.maximum(left, right)
            lo[many] = self.edge(s, a, l, h, d, False)
            hi[many] = self.edge(s, a, l, h, d, True)
            length[many] = d
        return lo, hi, length

    def sums(self, model: np.ndarray, base: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
        """Per text: tokens, known tokens, log10 of the base and of the model's probability."""
        token = self.rest > 0
        text = (np.cumsum(~token) - (~token))[token]
        n = int((~token).sum())
        each = (np.ones(len(text)), (c > 0)[token], np.log10(base[token]), np.log10(model[token]))
        return [np.bincount(text, v, n) for v in each]

    def base(self, total: int, distinct: int) -> tuple[np.ndarray, np.ndarray]:
        c = self.unigrams[self.word_of] if len(self.words) else np.zeros(len(self.rest), np.int64)
        return c, (c + 1) / (total + distinct + 1)


class Unseen(Texts):
    """Texts outside the corpus: each token's longest context is searched for."""

    def __init__(self, hashes: list[array]):
        super().__init__(hashes)
        n = len(self.rest)
        self.length, self.seen, self.hits = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
        at = np.flatnonzero(self.rest > 0)
        w = [self.word_of[np.minimum(at + i, n - 1)] for i in range(3)]
        # Shards number words in the order of their hashes, so this is the order of their keys.
        self.sorted = at[np.lexsort((w[2], w[1], w[0]))]
        self.follows = np.flatnonzero(self.rest > 1)

    def visit(self, s: Shard) -> None:
        self.meet(s)
        n = len(self.rest)
        counts = [np.zeros(n, np.int32) for _ in range(s.k)]
        low = np.zeros(n, np.int32)
        for i in range(0, len(self.sorted), 1 << 20):
            at = self.sorted[i : i + (1 << 20)]
            for m in range(1, s.k + 1):
                lo, hi = self.range(s, at, m)
                counts[m - 1][at] = hi - lo
            low[at] = lo
        for i in range(0, len(self.follows), 1 << 20):
            self._take(s, self.follows[i : i + (1 << 20)], counts, low)

    def _take(self, s: Shard, j: np.ndarray, counts: list[np.ndarray], low: np.ndarray) -> None:
        length = np.zeros(len(j), np.int64)
        for m in range(1, s.k + 1):
            length[counts[m - 1][j + 1] > 0] = m
        use = np.flatnonzero((length > 0) & ((length >= self.length[j]) | (length == s.k)))
        j, length = j[use], length[use]
        seen = np.zeros(len(j), np.int64)
        for m in range(1, s.k + 1):
            at = np.flatnonzero(length == m)
            seen[at] = counts[m - 1][j[at] + 1]
        lo = low[j + 1].astype(np.int64)
        deep = np.flatnonzero(length == s.k)
        if len(deep):
            p = j[deep] + 1
            x, y, reach = self.refine(s, p, lo[deep], lo[deep] + seen[deep], length[deep], self.rest[p].astype(np.int64))
            lo[deep], seen[deep], length[deep] = x, y - x, reach
        use = np.flatnonzero(length >= self.length[j])
        j, length, seen, lo = j[use], length[use], seen[use], lo[use]
        hits = np.zeros(len(j), np.int64)
        for m in range(1, s.k):
            at = np.flatnonzero(length == m)
            hits[at] = counts[m][j[at]]
        long = np.flatnonzero((length >= s.k) & (self.ids[j] > 0))
        few = long[seen[long] <= FEW]
        for i in range(FEW):
            few = few[lo[few] + i < lo[few] + seen[few]] if i == 0 else few[i < seen[few]]
            before = s.order[lo[few] + i].astype(np.int64) - 1  # a context is never first: its token is
            hits[few] += s.tokens[before] == self.ids[j[few]]
        many = long[seen[long] > FEW]
        if len(many):
            a, want = j[many], length[many] + 1
            x = low[a].astype(np.int64)
            y = x + counts[s.k - 1][a]
            x, y, reach = self.refine(s, a, x, y, np.minimum(s.k, want) * (y > x), want)
            hits[many] = np.where(reach == want, y - x, 0)
        longer = length > self.length[j]
        self.seen[j] = np.where(longer, 0, self.seen[j]) + seen
        self.hits[j] = np.where(longer, 0, self.hits[j]) + hits
        self.length[j] = length

    def result(self, total: int, distinct: int) -> list[np.ndarray]:
        c, base = self.base(total, distinct)
        model = np.where(self.length > 0, (self.hits + MASS * base) / (self.seen + MASS), base)
        return self.sums(model, base, c)


class Learned(Texts):
    """Texts of the corpus: the longest context of each token is all that precedes it.

    How often a text's first i tokens occur only falls with i, so each shard
    is asked for few i of a text, and those between equal counts are known.
    """

    def __init__(self, hashes: list[array]):
        super().__init__(hashes)
        self.ends = np.flatnonzero(self.rest == 0)
        self.sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
        self.steps = np.zeros(len(self.rest) + 1, np.int64)  # differences of the counts

    def count(self, s: Shard, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """How often the shard has the `length` tokens from each position."""
        out = np.zeros(len(at), np.int64)
        for n in range(1, s.k + 1):
            m = np.flatnonzero(length == n if n < s.k else length >= n)
            if not len(m):
                continue
            lo, hi = self.range(s, at[m], n)
            if n == s.k:
                reach = np.minimum(length[m], n) * (hi > lo)
                lo, hi, reach = self.refine(s, at[m], lo, hi, reach, length[m])
                hi = np.where(reach == length[m], hi, lo)
            out[m] = hi - lo
        return out

    def _add(self, text: np.ndarray, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> None:
        """Count `value` for the first i tokens of texts, a <= i < b."""
        np.add.at(self.steps, self.ends[text] - b + 1, value)
        np.add.at(self.steps, self.ends[text] - a + 1, -value)

    def visit(self, s: Shard) -> None:
        self.meet(s)
        text = np.arange(len(self.ends))
        a, b = np.ones(len(text), np.int64), self.sizes.copy()
        ca = self.count(s, self.ends - 1, a)
        text, a, b, ca = (v[ca > 0] for v in (text, a, b, ca))
        cb = self.count(s, self.ends[text] - b, b)
        self._add(text, b, b + 1, cb)
        while len(text):
            plain = (ca == cb) | (b - a <= 1)
            self._add(text[plain], a[plain], b[plain], ca[plain])
            text, a, b, ca, cb = (v[~plain] for v in (text, a, b, ca, cb))
            mid = np.minimum((a + b) // 2, 2 * a)  # most changes come early
            cm = self.count(s, self.ends[text] - mid, mid)
            left = (text, a, mid, ca, cm)
            on = cm > 0
            right = (text[on], mid[on], b[on], cm[on], cb[on])
            text, a, b, ca, cb = (np.concatenate([u, v]) for u, v in zip(left, right))

    def result(self, total: int, distinct: int) -> list[np.ndarray]:
        c, base = self.base(total, distinct)
        hits = np.cumsum(self.steps)[:-1]
        seen = np.append(hits[1:], 0)
        model = np.where(self.rest > 1, (hits + MASS * base) / (np.maximum(seen, 1) + MASS), base)
        return self.sums(model, base, c)


# Shards in the shared folder


def _write_shards(train: DataFrame, shards: int) -> tuple[str, int, int]:
    """Build shards of the texts and store them; returns the folder's URI, the tokens and the different words.

    Tasks write their shard as one file, under another name first, so that a
    task that is tried again or twice does no harm; what passes through Spark
    is the shard's words and their counts.
    """
    spark = train.sparkSession
    path = f"{shared_dir(spark)}/sparkhist-shards-{uuid.uuid4().hex}"
    _common.watch(spark, path)
    row = F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    dealt = train.select("text", row.alias("shard")).repartitionById(shards, "shard")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        hashes, shard = [], None
        for b in batches:
            if b.num_rows:
                shard = b.column("shard")[0].as_py()
                hashes += [word_hashes(t.as_py()) for t in b.column("text")]
        if shard is None:
            return
        s = Shard.build(hashes)
        system, root = fs.FileSystem.from_uri(path)
        system.create_dir(root, recursive=True)
        draft = f"{root}/draft-{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as f:
            parts = (s.vocabulary, s.tokens, s.order)
            f.write(np.array([x.nbytes for x in parts], np.int64).tobytes())
            for x in parts:
                f.write(memoryview(x).cast("B"))
        if system.get_file_info(f"{root}/shard-{shard}").type == fs.FileType.File:
            system.delete_file(draft)  # an earlier try got so far
        else:
            system.move(draft, f"{root}/shard-{shard}")
        words, counts = s.vocabulary.view(np.int64), s.counts
        del s, parts
        trim()
        for i in range(0, len(words), 1 << 16):
            yield pa.RecordBatch.from_arrays(
                [pa.array(words[i : i + (1 << 16)]), pa.array(counts[i : i + (1 << 16)].astype(np.int64))],
                names=["word", "n"],
            )

    found = dealt.mapInArrow(build, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    row = found.agg(F.sum("n"), F.count("*")).first()
    return path, int(row[0] or 0), int(row[1])


def _read_shard(path: str, shard: int) -> Shard | None:
    """A stored shard, or None where no text was dealt to it."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path)
    file = f"{root}/shard-{shard}"
    if system.get_file_info(file).type != fs.FileType.File:
        return None
    with system.open_input_file(file) as f:
        sizes = np.frombuffer(f.read(24), np.int64)
        parts = [np.frombuffer(f.read_buffer(int(n)), t) for n, t in zip(sizes, (np.uint64, np.int32, np.int32))]
    return Shard(*parts).open()


def _texts(docs: DataFrame, trains, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, learned), without nulls but for ids."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return src.withColumn("learned", F.coalesce(trains, F.lit(False)))


def _fewer(src: DataFrame, pieces: int, task_bytes: int) -> DataFrame:
    """The texts in tasks of `task_bytes` or more, if there are as many."""
    asked = max(1, -(-int(src.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0) // task_bytes))
    return src.coalesce(asked) if asked < pieces else src


def base_score(
    docs: DataFrame, trains, id_col: str = "doc_id", text_col: str = "text", batch_tokens: int = BATCH_TOKENS
) -> DataFrame:
    """`score` without the score: what the counts of words alone tell, of corpora of any size."""
    from sparkhist.llm import grams  # which builds on this module

    src = _texts(docs, trains, id_col, text_col)
    found, total = grams.base(_fewer(src, src.rdd.getNumPartitions(), 4 * batch_tokens), batch_tokens)
    return found.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score")


def score(
    docs: DataFrame,
    trains,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_bytes: int = SHARD_BYTES,
    batch_tokens: int = BATCH_TOKENS,
) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10).

    `trains` is a column over (doc_id, text): the rows to learn from; null is
    no.  A null text counts as empty, which has one token, its end.  Repeated
    rows are texts of their own and count as often; other columns are not
    read.  Without training rows all words are unknown and scores 0.
    """
    src = _texts(docs, trains, id_col, text_col)
    train = src.where("learned").select("text")
    size = train.agg(F.sum(F.octet_length("text") + 1), F.count("*")).first()
    # Fewer, larger tasks: each reads the shard, or stores a chunk, once for all its texts.
    pieces = max(1, src.rdd.getNumPartitions()) if size[1] else 1
    shards = -(-int(size[0] or 0) // shard_bytes) if size[1] else 0
    src = _fewer(src, pieces, (6 if shards <= 1 else 4) * batch_tokens)  # chunks, kept in memory whole, stay well below their limit
    columns = lambda df, n: df.select(
        "doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"
    )
    if shards > 1:
        from sparkhist.llm import grams  # which builds on this module

        return columns(*grams.score(src, batch_tokens))
    path, total, distinct = "", 0, 0
    if shards:
        path, total, distinct = _write_shards(train, shards)
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        learned: list[bool] = []
        hashes: list[array] = []
        waiting = 0
        key_type = None

        def flush() -> pa.RecordBatch:
            # Texts of the corpus in some groups, as numbering their words takes more memory than keeping the numbers.
            groups: list[tuple[Texts, list[int]]] = []
            for cls, want, most in ((Learned, True, PART_TOKENS), (Unseen, False, batch_tokens)):
                part, size = [], 0
                for i, known in enumerate(learned):
                    if known == want:
                        part.append(i)
                        size += len(hashes[i])
                        if size >= most:
                            groups.append((cls([hashes[k] for k in part]), part))
                            part, size = [], 0
                if part:
                    groups.append((cls([hashes[k] for k in part]), part))
            hashes.clear()  # of the texts, numbers of words remain
            trim()
            for i in range(shards):
                if (s := _read_shard(path, i)) is not None:
                    for texts, _ in groups:
                        texts.visit(s)
                        texts.ids = None
                del s
            out = [np.zeros(len(keys)) for _ in range(4)]
            for texts, at in groups:
                for o, v in zip(out, texts.result(total, distinct)):
                    o[at] = v
            result = pa.RecordBatch.from_arrays(
                [pa.array(keys, key_type), *(pa.array(v.astype(np.int64)) for v in out[:2]), *map(pa.array, out[2:])],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )
            keys.clear()
            learned.clear()
            groups.clear()
            trim()
            return result

        for b in batches:
            key_type = b.column("doc_id").type
            for key, text, known in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("learned").to_pylist()):
                keys.append(key)
                learned.append(known)
                hashes.append(word_hashes(text.as_py()))
                waiting += len(hashes[-1])
                if waiting >= batch_tokens:
                    yield flush()
                    waiting = 0
        if keys:
            yield flush()

    scored = src.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return columns(scored, total)


def _held_out():
    return F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))


def lm_digest(docs: DataFrame) -> DataFrame:
    """Scores of all documents by a model of those whose crc32(id as text) mod 7 isn't 2."""
    held = _held_out()
    return score(docs, ~held).select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def base_digest(docs: DataFrame) -> DataFrame:
    """`lm_digest` without the score."""
    held = _held_out()
    return base_score(docs, ~held).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score")
