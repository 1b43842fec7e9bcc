"""The scores of `infinigram` for corpora of many shards, with work in proportion to the text.

Texts are stored in chunks of numbered words.  Round m counts grams of m
words: chunks write the hashes of theirs with counts, sorted, and tasks that
each hold a range of hashes answer how often a gram that a text asks for
occurs in the corpus, and which grams of the corpus were asked for.  A text
asks on only where the gram before it and the gram after it were found, and
the corpus counts on only what was asked for.  That settles contexts of
fewer than DEPTH words.  Longer ones are searched for by doubling and
halving lengths, again by hashes in rounds.  In a chunk, places of the
corpus are sorted by the words there, so that passages with the same words
are one interval, however often a text repeats itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sparkhist.llm import _common
from sparkhist.llm import infinigram as ig
from sparkhist.llm._common import shared_dir, trim

#: Grams up to this length are counted; tokens of a chunk; different grams that a counting task holds, about.
DEPTH, CHUNK_TOKENS, PART_GRAMS = 8, 6_000_000, 6_000_000
#: Ranges of hashes that files are indexed by.
BUCKETS = 4096
_FACTORS = np.random.default_rng(8).integers(1 << 62, 1 << 63, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_KINDS = [np.dtype(t) for t in ("u1", "i4", "i8", "u8", "f8")]


# Files of arrays


def save(path: str, name: str, *arrays: np.ndarray) -> None:
    """Store arrays; under another name first, so that tasks that run twice do no harm."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path)
    target = f"{root}/{name}"
    system.create_dir(target.rsplit("/", 1)[0], recursive=True)
    draft = f"{target}-{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as f:
        f.write(np.array([len(arrays)] + [x for a in arrays for x in (_KINDS.index(a.dtype), len(a))], np.int64).tobytes())
        for a in arrays:
            if len(a):
                f.write(memoryview(np.ascontiguousarray(a)).cast("B"))
    if system.get_file_info(target).type == fs.FileType.File:
        system.delete_file(draft)
    else:
        system.move(draft, target)


class Stored:
    """Arrays that `save` wrote, whole or in slices."""

    def __init__(self, path: str, name: str):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(f"{root}/{name}")
        n = int(np.frombuffer(self.file.read(8), np.int64)[0])
        self.head = np.frombuffer(self.file.read(16 * n), np.int64).reshape(n, 2)
        sizes = np.array([_KINDS[k].itemsize * m for k, m in self.head.tolist()], np.int64)
        self.at = 8 + 16 * n + np.concatenate([[0], np.cumsum(sizes)])

    def read(self, k: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        kind, size = _KINDS[self.head[k, 0]], int(self.head[k, 1])
        hi = size if hi is None else hi
        data = self.file.read_at((hi - lo) * kind.itemsize, int(self.at[k]) + lo * kind.itemsize)
        return np.frombuffer(data, kind)

    def __enter__(self) -> Stored:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def narrow(n: np.ndarray) -> np.ndarray:
    """Counts in half the space, if they fit."""
    return n.astype(np.int64 if len(n) and n.max() >= 1 << 30 else np.int32)


def load(path: str, name: str) -> list[np.ndarray]:
    with Stored(path, name) as f:
        return [f.read(k) for k in range(len(f.head))]


def stored(path: str, name: str) -> bool:
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path)
    return system.get_file_info(f"{root}/{name}").type == fs.FileType.File


def drop(path: str, name: str) -> None:
    """Delete a file or folder, if it is there."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path)
    kind = system.get_file_info(f"{root}/{name}").type
    if kind == fs.FileType.Directory:
        system.delete_dir(f"{root}/{name}")
    elif kind == fs.FileType.File:
        system.delete_file(f"{root}/{name}")


# Chunks and their grams


class Chunk:
    """Texts as numbered words, one after another."""

    def __init__(self, path: str, name: str):
        with Stored(path, f"chunk/{name}") as f:
            self.vocabulary, self.ids, self.sizes, learned = (f.read(k) for k in range(4))
        self.learned = learned.astype(bool)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.text = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.off = np.arange(len(self.ids), dtype=np.int32) - np.repeat(self.starts.astype(np.int32), self.sizes)
        self.last = np.zeros(len(self.ids), bool)
        self.last[self.starts + self.sizes - 1] = True

    def grams(self, at: np.ndarray, m: int) -> np.ndarray:
        """Hashes of the m words that end at each position."""
        h = np.zeros(len(at), np.uint64)
        for i in range(m):
            h += self.vocabulary[self.ids[at - i]] * _FACTORS[i]
        return mixed(h)

    def combined(self, at: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """`combine` of those hashes."""
        if m > 1:
            return combine(self.grams(at, m))
        # Of single words, only the different ones are sorted.
        ids = self.ids[at]
        n = np.bincount(ids, minlength=len(self.vocabulary))
        there = np.flatnonzero(n)
        h, _, which = combine(mixed(self.vocabulary[there] * _FACTORS[0]))
        rank, total = np.zeros(len(n), np.int32), np.empty(len(h), np.int64)
        rank[there] = which
        total[which] = n[there]
        return h, total, rank[ids]


def mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def combine(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different hashes in order, how often each is there, and which of them each is."""
    order = np.argsort(h)
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    inverse = np.empty(len(s), np.int32)
    inverse[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    return s[starts], np.diff(np.append(starts, len(s))), inverse


def index(h: np.ndarray) -> np.ndarray:
    """Where each range of hashes begins."""
    bounds = np.arange(1, BUCKETS, dtype=np.uint64) << np.uint64(52)
    return np.concatenate([[0], np.searchsorted(h, bounds), [len(h)]]).astype(np.int64)


def cut(part: int, parts: int) -> tuple[int, int]:
    return BUCKETS * part // parts, BUCKETS * (part + 1) // parts


def write_grams(path: str, m: int, name: str, corpus, unseen: np.ndarray, learned: np.ndarray) -> None:
    """The corpus's grams with their counts, and those asked for by texts outside it and by texts in it."""
    h, n = corpus
    at, many = index(h), n >= 255
    before = np.concatenate([[0], np.cumsum(many)])[at].astype(np.int64)
    save(
        path, f"grams-{m}/{name}", at, before, index(unseen), index(learned),
        h, np.minimum(n, 255).astype(np.uint8), n[many].astype(np.int64), unseen, learned,
    )


def answer(path: str, m: int, names: list[str], part: int, parts: int) -> tuple[int, int]:
    """Count the grams of a range of hashes; returns their number in the corpus, and of different ones."""
    lo, hi = cut(part, parts)
    corpus, counts, asked = [], [], ([], [])
    for name in names:
        with Stored(path, f"grams-{m}/{name}") as f:
            span = [f.read(k, lo, hi + 1) for k in range(4)]
            a, b = int(span[0][0]), int(span[0][-1])
            corpus.append(f.read(4, a, b))
            n = f.read(5, a, b).astype(np.int64)
            n[n == 255] = f.read(6, int(span[1][0]), int(span[1][-1]))
            counts.append(n)
            for i in (0, 1):
                asked[i].append(f.read(7 + i, int(span[2 + i][0]), int(span[2 + i][-1])))
    return reply(path, m, part, corpus, counts, asked)


def reply(path: str, m: int, part: int, corpus: list, counts: list, asked: tuple[list, list]) -> tuple[int, int]:
    """Store the answers to all chunks; returns the number of grams in the corpus, and of different ones."""
    chunks, sizes = len(corpus), [len(x) for x in corpus]
    h, n = np.concatenate(corpus), np.concatenate(counts)
    corpus.clear()
    counts.clear()
    known, _, which = combine(h)
    del h
    total = np.bincount(which, n, len(known)).astype(np.int64)
    found, wanted = [], []
    for i in (0, 1):
        q, _, back = combine(np.concatenate(asked[i]))
        at = np.searchsorted(known, q)
        hit = np.flatnonzero(at < len(known))
        hit = hit[known[at[hit]] == q[hit]]
        number = np.zeros(len(q), np.int64)
        number[hit] = total[at[hit]]
        found.append(np.split(number[back], np.cumsum([len(x) for x in asked[i]])[:-1]))
        want = np.zeros(len(known), bool)
        want[at[hit]] = True
        # A text of the corpus finds itself; beyond that it asks on only for what occurs again.
        want &= total > i
        wanted.append(np.split(want[which], np.cumsum(sizes)[:-1]))
    wide = np.array([len(total) > 0 and int(total.max()) >= 1 << 31], np.uint8)
    kind = np.int64 if wide[0] else np.int32
    pieces = []
    for k in range(chunks):
        pieces += [np.packbits(wanted[0][k]), np.packbits(wanted[1][k])]
        pieces += [found[i][k].astype(kind).view(np.uint8) for i in (0, 1)]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
    save(path, f"answers-{m}/{part}", wide, offsets, np.concatenate(pieces))
    return int(total.sum()), len(known)


def read_answers(path: str, m: int, number: int, parts: int, corpus: np.ndarray) -> list[np.ndarray]:
    """For a chunk's grams: asked for by texts outside the corpus, by texts in it; counts of what the chunk asked for."""
    at, out = index(corpus), ([], [], [], [])
    for part in range(parts):
        lo, hi = cut(part, parts)
        n = int(at[hi] - at[lo])
        with Stored(path, f"answers-{m}/{part}") as f:
            kind = np.int64 if f.read(0)[0] else np.int32
            o = f.read(1, 4 * number, 4 * number + 5)
            data = f.read(2, int(o[0]), int(o[4]))
        o = o - o[0]
        for i in (0, 1):
            out[i].append(np.unpackbits(data[o[i] : o[i + 1]], count=n).astype(bool))
            out[2 + i].append(np.frombuffer(data[o[2 + i] : o[3 + i]].tobytes(), kind).astype(np.int64))
    return [np.concatenate(x) for x in out]


class Round:
    """What a chunk counts and asks for in round m, from the state that the round before left."""

    def __init__(self, path: str, chunk: Chunk, name: str, m: int):
        self.chunk = c = chunk
        self.path, self.name, self.m = path, name, m
        trained = c.learned[c.text]
        if m == 1:
            # Grams of no words: they are everywhere.
            self.at = np.flatnonzero(trained)
            self.found = np.flatnonzero(~trained)
            self.seen = np.ones(len(self.found), np.int64)
            self.prefix = np.where(c.learned, 2, 0).astype(np.int64)
            self.score = np.zeros(len(c.sizes))
        else:
            live, self.found, self.seen, self.prefix, self.score = load(path, f"state-{m - 1}/{name}")
            self.at, self.found = np.flatnonzero(np.unpackbits(live, count=len(c.ids))), self.found.astype(np.int64)
        self.score = self.score.copy()
        there = np.zeros(len(c.ids), bool)
        there[self.found] = True
        ask = self.found[c.off[self.found] >= m - 1]
        self.ask = ask[there[ask - 1]] if m > 1 else ask
        self.texts = np.flatnonzero((self.prefix > 1) & (c.sizes >= m))
        self.corpus = c.combined(self.at, m)
        self.asked = [c.combined(at, m) for at in (self.ask, c.starts[self.texts] + m - 1)]

    def write(self) -> int:
        write_grams(self.path, self.m, self.name, self.corpus[:2], self.asked[0][0], self.asked[1][0])
        return len(self.corpus[0])

    def settle(self, number: int, parts: int, total: int, distinct: int) -> None:
        """Take the answers: add up what is settled now, and keep what isn't."""
        c, m = self.chunk, self.m
        of_word = (load(self.path, f"words/{self.name}")[0] + 1) / (total + distinct + 1)
        base = lambda j: of_word[c.ids[j]]
        wanted, again, n, prefix = read_answers(self.path, m, number, parts, self.corpus[0])
        out = np.zeros(len(c.ids), np.int64)  # how often the gram that ends here occurs
        out[self.ask] = n[self.asked[0][2]]
        # Contexts that ended here with m - 1 words and are not found with m.
        done = (out[self.found] == 0) & ~c.last[self.found]
        j, seen = self.found[done] + 1, self.seen[done]
        hits = out[j]
        p = (hits + ig.MASS * base(j)) / (seen + ig.MASS) if m > 1 else base(j)
        if m == 1:  # first words have no context
            self.score += np.bincount(c.text[c.starts], np.log10(base(c.starts)), len(c.sizes))
        self.score += np.bincount(c.text[j], np.log10(p), len(c.sizes))
        prefix = prefix[self.asked[1][2]]
        after = np.zeros(len(c.sizes), np.int64)
        after[self.texts] = prefix
        if m > 1:
            j = c.starts[self.texts] + m - 1
            self.score[self.texts] += np.log10((prefix + ig.MASS * base(j)) / (self.prefix[self.texts] + ig.MASS))
        # A beginning that occurs once is the text's own, and so is all that follows.
        once = np.zeros(len(c.sizes), bool)
        once[self.texts] = prefix == 1
        j = np.flatnonzero(once[c.text] & (c.off >= m))
        self.score += np.bincount(c.text[j], np.log10((1 + ig.MASS * base(j)) / (1 + ig.MASS)), len(c.sizes))
        self.found = np.flatnonzero(out)
        self.seen, self.prefix = out[self.found], after
        which = self.corpus[2]
        by, of = np.zeros(len(c.ids), bool), np.zeros(len(c.ids), bool)
        by[self.at], of[self.at] = wanted[which], again[which]
        if m == DEPTH:
            self._go_on(by, of)
            live = np.zeros(0, bool)
        else:
            live = np.zeros(len(c.ids), bool)
            live[1:] = (by[1:] & by[:-1]) | of[:-1]
            live &= c.off >= m
        state = (np.packbits(live), self.found.astype(np.int32), narrow(self.seen), narrow(self.prefix), self.score)
        save(self.path, f"state-{m}/{self.name}", *state)

    def _go_on(self, by: np.ndarray, of: np.ndarray) -> None:
        """Leave what has DEPTH words in common, or more, to the search for lengths."""
        c = self.chunk
        s = Search()
        orders = [sorted_ends(c, np.flatnonzero(by)), sorted_begins(c, np.flatnonzero(of) + 1 - DEPTH)]
        spot, room = (np.concatenate([o[k] for o in orders]).astype(np.int32) for k in (0, 1))
        save(self.path, f"places/{self.name}", spot, room)
        # Places with the same DEPTH words stand together.
        kind = np.repeat(np.array([ENDS, BEGINS], np.int32), [len(o[0]) for o in orders])
        at = np.where(kind == ENDS, spot - 1, spot + DEPTH - 1)
        h = c.grams(at, DEPTH) if len(at) else np.zeros(0, np.uint64)
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (kind[1:] != kind[:-1])
        s.first = np.flatnonzero(new).astype(np.int32)
        s.last = np.append(s.first[1:], len(h)).astype(np.int32)[: len(s.first)]
        s.kind, s.low = kind[s.first], np.full(len(s.first), DEPTH, np.int32)
        u, p = self.found, np.flatnonzero((self.prefix > 1) & (c.sizes > DEPTH))
        s.ask_kind = np.repeat(np.array([ENDS, BEGINS], np.uint8), (len(u), len(p)))
        s.ask_text = np.append(c.text[u], p).astype(np.int32)
        s.ask_place = np.append(c.off[u] + 1, np.zeros(len(p), np.int64)).astype(np.int32)
        s.ask_low = np.full(len(s.ask_text), DEPTH, np.int32)
        s.ask_n = np.append(self.seen, self.prefix[p])
        s.ask_high = np.zeros(len(s.ask_text), np.int64)
        # All of a text's words before the next one: no longer context there.
        s.finish((s.ask_kind == ENDS) & (s.ask_place == DEPTH))
        s.save(self.path, 0, self.name)


# Lengths beyond DEPTH

#: What is looked for: longest contexts, by where they end, and beginnings of texts, by where they begin.
ENDS, BEGINS = 0, 1
_BACK = pow(int(ig._B), -1, 1 << 64)
_BACK_LOW = ig._powers(1 << 14, np.uint64(_BACK))
with np.errstate(over="ignore"):
    _BACK_HIGH = ig._powers(1 << 17, _BACK_LOW[-1] * np.uint64(_BACK))
_BACK2 = pow(ig._B2, -1, int(ig._P))
_BACK2_LOW = ig._prime_powers(1 << 14, _BACK2)
_BACK2_HIGH = ig._prime_powers(1 << 17, int(_BACK2_LOW[-1]) * _BACK2 % int(ig._P))


def sorted_ends(c: Chunk, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of contexts, sorted by the words before them, last word first, and how many words may match.

    `at` are the last words of all that has DEPTH words in common with a
    text that asks, so what is longer lies in runs of them.
    """
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1] + 1
    run = np.cumsum(new) - 1
    a = at[new] - DEPTH + 1
    size = np.bincount(run, minlength=len(a)) + DEPTH - 1
    stop = np.cumsum(size + 1) - 1  # a run back to front, then its end
    which = np.repeat(np.arange(len(a)), size + 1)
    room = stop[which] - np.arange(len(which))
    word = np.maximum(a[which] + room - 1, 0)
    return _sorted(c, word, room, room >= DEPTH, 1)


def sorted_begins(c: Chunk, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of texts, sorted by the words from there on, and how many words there are."""
    texts, first = np.unique(c.text[at], return_index=True)
    a = at[first]
    size = c.starts[texts] + c.sizes[texts] - a
    stop = np.cumsum(size + 1) - 1
    which = np.repeat(np.arange(len(a)), size + 1)
    room = stop[which] - np.arange(len(which))
    word = a[which] + size[which] - room
    keep = np.zeros(len(c.ids) + 1, bool)
    keep[at] = True
    return _sorted(c, word, room, keep[word] & (room > 0), 0)


def _sorted(c: Chunk, word: np.ndarray, room: np.ndarray, keep: np.ndarray, add: int) -> tuple[np.ndarray, np.ndarray]:
    if not len(word):
        return word, room
    end = room == 0
    tokens = np.where(end, len(c.vocabulary) + np.cumsum(end), c.ids[np.minimum(word, len(c.ids) - 1)] + 1)
    bits = int(tokens.max()).bit_length()
    order = ig.suffix_array(tokens.astype(np.int32), bits, max(1, min(3, 63 // bits)))
    order = order[keep[order]]
    return word[order] + add, room[order]


class Ranges:
    """Hashes of ranges of words in a chunk, whatever their place; long ones by two hashes.

    `words` are some of each text that takes part.
    """

    def __init__(self, path: str, name: str, words: np.ndarray):
        with Stored(path, f"chunk/{name}") as f:
            vocabulary, ids, self.sizes = (f.read(k) for k in range(3))
        self.starts = np.cumsum(self.sizes) - self.sizes
        live = np.zeros(len(ids), bool)
        live[words] = True
        live = np.logical_or.reduceat(live, self.starts)
        kept = np.where(live, self.sizes, 0)
        #: How far the words of a text move as others are left out.
        self.shift = np.repeat((np.cumsum(kept) - kept - self.starts).astype(np.int32), self.sizes)
        self.ids, self.vocabulary, self.second = ids[np.repeat(live, self.sizes)], vocabulary, None
        self.first = ig.prefix_hashes(self.ids, vocabulary)

    def hashes(self, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
        a = begin + self.shift[begin]
        h = (self.first[a + n] - self.first[a]) * (_BACK_HIGH[a >> 14] * _BACK_LOW[a & 16383])
        long = np.flatnonzero(n >= ig.SURE)
        if len(long):
            if self.second is None:
                self.second = ig.prime_hashes(self.ids, self.vocabulary)
            a, b = a[long], a[long] + n[long]
            x = (self.second[b].astype(np.int64) - self.second[a]) % ig._P
            x = x * (_BACK2_HIGH[a >> 14] * _BACK2_LOW[a & 16383] % ig._P) % ig._P
            h[long] ^= x.astype(np.uint64) * _FACTORS[0]
        return mixed(h + n.astype(np.uint64) * _FACTORS[1])


def step_of(low: np.ndarray, r: int) -> np.ndarray:
    """How many words more are tried in round r where `low` are known to match.

    Round r tries twice 2^r * DEPTH; between powers of two it halves the
    steps, one round after another.
    """
    power = np.frexp(low.astype(np.float64))[1].astype(np.int64) - 1
    return (np.int64(1) << power) >> (r + DEPTH.bit_length() - 1 - power)


class Search:
    """Lengths that are looked for in a chunk by doubling and halving, and passages of the corpus that may have them.

    Passages with the same words are one interval of the sorted places, so
    texts that repeat themselves cost no more than others.  They take part
    as long as someone who has them asks for more.
    """

    PASSAGES = {"kind": np.int32, "low": np.int32, "first": np.int32, "last": np.int32}
    ASKS = {"ask_kind": np.uint8, "ask_text": np.int32, "ask_place": np.int32, "ask_low": np.int32, "ask_n": np.int64, "ask_high": np.int64}
    #: Longest contexts: text, end, length, count.  Counts of a text's first words: text, number, count, valid up to the next.
    FOUND = {"end_text": np.int32, "end": np.int32, "length": np.int32, "seen": np.int64, "from_text": np.int32, "from": np.int32, "count": np.int64}

    def __init__(self):
        for k, t in (self.PASSAGES | self.ASKS | self.FOUND).items():
            setattr(self, k, np.zeros(0, t))

    def save(self, path: str, r: int, name: str) -> None:
        columns = self.PASSAGES | self.ASKS | self.FOUND
        save(path, f"search-{r}/{name}", *(np.asarray(getattr(self, k), t) for k, t in columns.items()))

    @classmethod
    def load(cls, path: str, r: int, name: str) -> Search:
        out = cls()
        for k, v in zip(out.PASSAGES | out.ASKS | out.FOUND, load(path, f"search-{r}/{name}")):
            setattr(out, k, v)
        return out

    def add(self, **more: np.ndarray) -> None:
        for k, v in more.items():
            setattr(self, k, np.append(getattr(self, k), v))

    def finish(self, done: np.ndarray) -> None:
        """These contexts can't be longer."""
        at = np.flatnonzero(done)
        self.add(end_text=self.ask_text[at], end=self.ask_place[at], length=self.ask_low[at], seen=self.ask_n[at])
        for k in self.ASKS:
            setattr(self, k, getattr(self, k)[~done])

    def write(self, path: str, r: int, name: str) -> int:
        """Hashes of what matches and of what is tried, by ranges of the hash of the DEPTH words that all agree in."""
        spot, room = load(path, f"places/{name}")
        inside = np.zeros(len(spot) + 1, np.int64)
        np.add.at(inside, self.first, 1)
        np.add.at(inside, self.last, -1)
        among = np.cumsum(inside)[:-1] > 0
        with Stored(path, f"chunk/{name}") as f:
            sizes = f.read(2)
        starts = np.cumsum(sizes) - sizes
        # Ends, which are beyond the last word, come before beginnings.
        ends = np.arange(len(spot)) < self.last[self.kind == ENDS].max(initial=0)
        ranges = Ranges(path, name, np.concatenate([(spot - ends)[among], starts[self.ask_text]]))

        def hashes(kind, spot, n):
            return ranges.hashes(np.where(kind == ENDS, spot - n, spot).astype(np.int64), n) ^ (kind.astype(np.uint64) * _FACTORS[2])

        def tried(kind, spot, low, room, lo, odd):
            to = low + step_of(low, r)
            fits = to <= room
            h = hashes(kind, spot, np.where(fits, to, low))
            return np.where(fits, h, lo ^ odd), fits

        lo = hashes(self.kind, spot[self.first], self.low)
        base = hashes(self.kind, spot[self.first], np.full(len(lo), DEPTH))

        def key(item, i):
            odd = (i + 1).astype(np.uint64) * _FACTORS[3]  # what is too short is like nothing else
            return tried(self.kind[item], spot[i], self.low[item], room[i], lo[item], odd)[0]

        # Equal ones stand together, so an interval whose ends agree is all the same; others are cut in two.
        item, a, b = np.arange(len(lo)), self.first.astype(np.int64), self.last.astype(np.int64)
        x, y = key(item, a), key(item, b - 1)
        done = []
        while len(item):
            same = x == y
            done.append([v[same] for v in (item, a, b, x)])
            item, a, b, x, y = (v[~same] for v in (item, a, b, x, y))
            m = (a + b) >> 1
            x, y = np.concatenate([x, key(item, m)]), np.concatenate([key(item, m - 1), y])
            item, a, b = np.concatenate([item, item]), np.concatenate([a, m]), np.concatenate([m, b])
        item, a, b, mid = (np.concatenate(v) for v in zip(*done)) if done else (item, a, b, x)
        order = np.argsort(item << 32 | a)
        item, a, b, mid = (v[order] for v in (item, a, b, mid))
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (mid[1:] != mid[:-1])
        i = np.flatnonzero(new)
        b = b[np.append(i[1:], len(item))[: len(i)] - 1]
        item, a, mid = item[i], a[i], mid[i]
        # Of those too short, one is left where there is nothing else.
        fits = room[a] >= (self.low + step_of(self.low, r))[item]
        some = np.zeros(len(lo), bool)
        some[item[fits]] = True
        alone = ~some[item]
        alone[1:] &= item[1:] != item[:-1]
        keep = np.flatnonzero(fits | alone)
        keep = keep[np.argsort(base[item[keep]] >> np.uint64(52), kind="stable")]
        item, a, b, mid = item[keep], a[keep], b[keep], mid[keep]

        ask_spot = starts[self.ask_text] + self.ask_place
        ask_room = np.where(self.ask_kind == ENDS, self.ask_place, sizes[self.ask_text])
        ask_lo = hashes(self.ask_kind, ask_spot, self.ask_low)
        ask_base = hashes(self.ask_kind, ask_spot, np.full(len(ask_lo), DEPTH))
        ask_mid, _ = tried(self.ask_kind, ask_spot, self.ask_low, ask_room, ask_lo, _FACTORS[4])
        turn = np.argsort(ask_base >> np.uint64(52), kind="stable").astype(np.int32)
        step = step_of(self.ask_low, r)
        rule = (step > 1) * 1 + ((step > 1) & (self.ask_low + step < ask_room)) * 2 + (self.ask_kind == BEGINS) * 4 + (step == self.ask_low) * 8
        at, to = (index(x >> np.uint64(52) << np.uint64(52)) for x in (base[item], ask_base[turn]))
        save(
            path, f"tries-{r}/{name}", at, to,
            lo[item], mid, (b - a).astype(np.int32),
            ask_lo[turn], ask_mid[turn], rule.astype(np.uint8)[turn], self.ask_n[turn], self.ask_high[turn],
        )
        save(path, f"turns-{r}/{name}", *(v.astype(np.int32) for v in (item, a, b, turn)), at)
        return len(item) + len(turn)

    def take(self, path: str, r: int, name: str, number: int, parts: int) -> Search:
        """What is left to look for after round r."""
        item, first, last, turn, at = load(path, f"turns-{r}/{name}")
        left, right, n = [], [], []
        for part in range(parts):
            lo, hi = cut(part, parts)
            k = int(at[hi] - at[lo])
            with Stored(path, f"found-{r}/{part}") as f:
                o = f.read(0, 3 * number, 3 * number + 4)
                data = f.read(1, int(o[0]), int(o[3]))
            o = o - o[0]
            left.append(np.unpackbits(data[: o[1]], count=k).astype(bool))
            right.append(np.unpackbits(data[o[1] : o[2]], count=k).astype(bool))
            n.append(np.frombuffer(data[o[2] :].tobytes(), np.int64))
        left, right = item[np.concatenate(left)], np.concatenate(right)
        stay = np.zeros(len(self.low), bool)
        stay[left] = True
        mid = np.empty(len(turn), np.int64)
        mid[turn] = np.concatenate(n)
        with Stored(path, f"chunk/{name}") as f:
            sizes = f.read(2)
        out = Search()
        out.add(**{k: getattr(self, k) for k in self.FOUND})
        out.add(**{k: getattr(self, k)[stay] for k in self.PASSAGES})
        item = item[right]
        low = (self.low + step_of(self.low, r))[item].astype(np.int32)
        out.add(kind=self.kind[item], low=low, first=first[right], last=last[right])
        step = step_of(self.ask_low, r)
        ends = self.ask_kind == ENDS
        hit = ends & (mid > 0)
        low, count = np.where(hit, self.ask_low + step, self.ask_low).astype(np.int32), np.where(hit, mid, self.ask_n)
        done = (step == 1) | (low == self.ask_place)
        at = np.flatnonzero(ends & done)
        out.add(end_text=self.ask_text[at], end=self.ask_place[at], length=low[at], seen=count[at])
        at = np.flatnonzero(ends & ~done)
        out.add(
            ask_kind=self.ask_kind[at], ask_text=self.ask_text[at], ask_place=self.ask_place[at],
            ask_low=low[at], ask_n=count[at], ask_high=self.ask_high[at],
        )
        # Beginnings: counts only fall, so those between equal ones are known.
        size, up = sizes[self.ask_text], step == self.ask_low
        to, n = (self.ask_low + step).astype(np.int32), self.ask_n
        same = (mid == n) | (step == 1)
        ends_here = np.where(up, mid == 1, (mid == self.ask_high) | (step == 1)) | (to == size)
        for keep, closed, low, count, high in (
            (~ends, same, self.ask_low, n, mid),
            (~ends & (to <= size), ends_here, to, mid, np.where(up, 0, self.ask_high)),
        ):
            at = np.flatnonzero(keep & closed)
            out.add(**{"from_text": self.ask_text[at], "from": low[at], "count": count[at]})
            at = np.flatnonzero(keep & ~closed)
            out.add(
                ask_kind=self.ask_kind[at], ask_text=self.ask_text[at], ask_place=self.ask_place[at],
                ask_low=low[at], ask_n=count[at], ask_high=high[at],
            )
        return out


def find(path: str, r: int, names: list[str], part: int, parts: int) -> None:
    """Count what is tried in round r, and tell places of the corpus which of their lengths are still asked for."""
    lo, hi = cut(part, parts)
    got: list[list[np.ndarray]] = [[] for _ in range(8)]
    for name in names:
        with Stored(path, f"tries-{r}/{name}") as f:
            spans = [f.read(k, lo, hi + 1)[[0, -1]].tolist() for k in (0, 1)]
            for k in range(8):
                got[k].append(f.read(2 + k, *spans[k >= 3]))
    sizes, asked = ([len(x) for x in got[k]] for k in (0, 3))
    low, mid, n, ask_low, ask_mid, rule, ask_n, ask_high = map(np.concatenate, got)
    del got
    known, _, which = combine(mid)
    total = np.bincount(which, n, len(known)).astype(np.int64)
    at = np.searchsorted(known, ask_mid)
    hit = np.flatnonzero(at < len(known))
    hit = hit[known[at[hit]] == ask_mid[hit]]
    count = np.zeros(len(ask_mid), np.int64)
    count[hit] = total[at[hit]]
    begins, up = (rule & 4) > 0, (rule & 8) > 0
    stay = ((rule & 1) > 0) & np.where(begins, count != ask_n, count == 0)
    on = ((rule & 2) > 0) & np.where(begins, np.where(up, count > 1, count != ask_high), count > 0)
    want = np.zeros(len(known), bool)
    on = hit[on[hit]]
    want[at[on]] = True
    pieces: list[np.ndarray] = []
    left, right = np.isin(low, np.unique(ask_low[stay])), want[which]
    at, to = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([[0], np.cumsum(asked)])
    for k in range(len(names)):
        pieces += [np.packbits(x[at[k] : at[k + 1]]) for x in (left, right)]
        pieces.append(count[to[k] : to[k + 1]].view(np.uint8))
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
    save(path, f"found-{r}/{part}", offsets, np.concatenate(pieces))


def add_up(path: str, r: int, name: str, total: int, distinct: int) -> None:
    """The scores of a chunk's texts: those of short contexts and those of the lengths found."""
    s, c = Search.load(path, r, name), Chunk(path, name)
    base = ((load(path, f"words/{name}")[0] + 1) / (total + distinct + 1))[c.ids]
    score = load(path, f"state-{DEPTH}/{name}")[4].copy()
    length, seen = np.zeros(len(c.ids), np.int32), np.zeros(len(c.ids), np.int64)
    at = c.starts[s.end_text] + s.end - 1
    length[at], seen[at] = s.length, s.seen
    at = at[~c.last[at]]
    j = at + 1
    # A context grows by one word at most; if it does, its longest one now holds that word, else none did.
    hits = np.where(length[j] == length[at] + 1, seen[j], 0)
    score += np.bincount(c.text[j], np.log10((hits + ig.MASS * base[j]) / (seen[at] + ig.MASS)), len(score))
    begin = getattr(s, "from").astype(np.int64)
    order = np.lexsort((begin, s.from_text))
    text, begin, count = s.from_text[order], begin[order], s.count[order]
    last = np.append(text[1:] != text[:-1], True)[: len(text)]
    until = np.where(last, c.sizes[text] + 1, np.append(begin[1:], 0)[: len(text)])
    times = until - begin
    n, of = np.repeat(count, times), np.repeat(text, times)
    i = np.repeat(begin, times) + np.arange(len(n)) - np.repeat(np.cumsum(times) - times, times)
    k = np.flatnonzero(i < c.sizes[of])  # the word after i others; the next count is with it
    j = c.starts[of[k]] + i[k]
    score += np.bincount(of[k], np.log10((n[np.minimum(k + 1, len(n) - 1)] + ig.MASS * base[j]) / (n[k] + ig.MASS)), len(score))
    save(path, f"score/{name}", score)


# Jobs


def each(spark: SparkSession, n: int, work: Callable[[int], tuple[int, int]]) -> list[tuple[int, int]]:
    """Run `work` for 0 .. n - 1, in two tasks a core, or more of 16 each: rounds are many and a task has its price."""
    tasks = max(-(-n // 16), min(n, 2 * spark.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                x, y = work(i)
                trim()
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (i, x, y)], names=["i", "x", "y"])

    rows = spark.range(0, n, 1, tasks).mapInArrow(run, "i long, x long, y long").collect()
    return [(r.x, r.y) for r in sorted(rows, key=lambda r: r.i)]


def _deal(src: DataFrame, path: str, chunk_tokens: int) -> dict[str, int]:
    """Store the texts in chunks; returns each chunk's name and number of different words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[pa.Array] = []
        learned: list[bool] = []
        hashes: list = []

        def flush() -> pa.RecordBatch:
            name = uuid.uuid4().hex
            sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
            flat = np.concatenate([np.frombuffer(h, np.uint64) for h in hashes])
            hashes.clear()
            vocabulary, _, ids = combine(flat)
            del flat
            known = np.array(learned, bool)
            column = pa.RecordBatch.from_arrays([pa.concat_arrays(keys)], names=["doc_id"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, column.schema) as w:
                w.write_batch(column)
            save(path, f"chunk/{name}", vocabulary, ids, sizes, known.astype(np.uint8), np.frombuffer(sink.getvalue(), np.uint8))
            keys.clear()
            learned.clear()
            trim()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(vocabulary)])], names=["name", "n"])

        waiting = 0
        for b in batches:
            known, begin = b.column("learned").to_pylist(), 0
            for i, t in enumerate(b.column("text")):
                hashes.append(ig.word_hashes(t.as_py()))
                learned.append(known[i])
                waiting += len(hashes[-1])
                if waiting >= chunk_tokens:
                    keys.append(b.column("doc_id").slice(begin, i + 1 - begin))
                    yield flush()
                    waiting, begin = 0, i + 1
            if begin < b.num_rows:
                keys.append(b.column("doc_id").slice(begin))
        if hashes:
            yield flush()

    return {r.name: r.n for r in sorted(src.mapInArrow(run, "name string, n long").collect())}


def _count_words(spark: SparkSession, path: str, names: list[str], parts: int) -> tuple[int, int]:
    """Words as the grams of round 0, by a shuffle; returns the words of the corpus, and the different ones."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                c = Chunk(path, names[i])
                n = np.bincount(c.ids[c.learned[c.text]], minlength=len(c.vocabulary))
                words, n = c.vocabulary[n > 0], n[n > 0]
                at, to = index(words), index(c.vocabulary)
                for part in range(parts):
                    lo, hi = cut(part, parts)
                    a, b, x, y = at[lo], at[hi], to[lo], to[hi]
                    blobs = (words[a:b], narrow(n[a:b]), c.vocabulary[x:y])
                    wide = blobs[1].dtype == np.int64
                    columns = [pa.array([v], pa.int32()) for v in (part, i, int(wide))]
                    columns += [pa.array([v.tobytes()], pa.binary()) for v in blobs]
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "chunk", "wide", "words", "n", "asked"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["chunk"])
        if rows:
            words, asked = ([np.frombuffer(r[k], np.uint64) for r in rows] for k in ("words", "asked"))
            n = [np.frombuffer(r["n"], np.int64 if r["wide"] else np.int32) for r in rows]
            x, y = reply(path, 0, rows[0]["part"], words, n, (asked, [a[:0] for a in asked]))
            yield pa.RecordBatch.from_arrays([pa.array([x]), pa.array([y])], names=["x", "y"])

    sent = spark.range(0, len(names), 1, max(1, len(names))).mapInArrow(
        send, "part int, chunk int, wide int, words binary, n binary, asked binary"
    )
    rows = sent.repartitionById(parts, "part").mapInArrow(count, "x long, y long").collect()
    return sum(r.x for r in rows), sum(r.y for r in rows)


def _words(path: str, c: Chunk, number: int, parts: int, total: int, distinct: int) -> list[np.ndarray]:
    """How often each word of a chunk occurs in the corpus; known words and base scores of its texts."""
    n = np.bincount(c.ids[c.learned[c.text]], minlength=len(c.vocabulary))
    counts = read_answers(path, 0, number, parts, c.vocabulary[n > 0])[2]
    known = np.bincount(c.text, (counts > 0)[c.ids], len(c.sizes))
    base = np.bincount(c.text, np.log10((counts + 1) / (total + distinct + 1))[c.ids], len(c.sizes))
    return [counts, known.astype(np.int64), base]


def _folder(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/sparkhist-grams-{uuid.uuid4().hex}"
    _common.watch(spark, path)
    return path


def _keys(f: Stored) -> pa.Array:
    """The ids of a stored chunk's texts."""
    return pa.ipc.open_stream(pa.py_buffer(f.read(4))).read_all().column(0).combine_chunks()


def base(src: DataFrame, chunk_tokens: int = CHUNK_TOKENS, part_grams: int = PART_GRAMS) -> tuple[DataFrame, int]:
    """`score` without the score: words are counted, grams are not.  There may be no rows to learn from."""
    spark = src.sparkSession
    path = _folder(spark)
    dealt = _deal(src, path, chunk_tokens)
    names, chunks = list(dealt), len(dealt)
    parts = max(1, min(BUCKETS, -(-2 * sum(dealt.values()) // part_grams)))
    total, distinct = _count_words(spark, path, names, parts)

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                with Stored(path, f"chunk/{names[i]}") as f:
                    keys = _keys(f)
                c = Chunk(path, names[i])
                _, known, base = _words(path, c, i, parts, total, distinct)
                columns = [keys, *map(pa.array, (c.sizes, known, base))]
                del c
                trim()
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "base_score"])

    kind = src.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, n_known long, base_score double"
    return spark.range(0, chunks, 1, max(1, chunks)).mapInArrow(result, schema), total


def score(src: DataFrame, chunk_tokens: int = CHUNK_TOKENS, part_grams: int = PART_GRAMS) -> tuple[DataFrame, int]:
    """Scores of (doc_id, text, learned) as in `infinigram.score`, without train_tokens, and that number beside.

    There must be rows to learn from.
    """
    spark = src.sparkSession
    path = _folder(spark)
    dealt = _deal(src, path, chunk_tokens)
    names, chunks = list(dealt), len(dealt)

    def ask(m: int, grams: int) -> int:
        parts = max(1, min(BUCKETS, -(-grams // part_grams)))
        each(spark, parts, lambda p: answer(path, m, names, p, parts))
        drop(path, f"grams-{m}")
        return parts

    parts = max(1, min(BUCKETS, -(-2 * sum(dealt.values()) // part_grams)))
    total, distinct = _count_words(spark, path, names, parts)

    def begin(i: int) -> tuple[int, int]:
        c = Chunk(path, names[i])
        counts, *sums = _words(path, c, i, parts, total, distinct)
        save(path, f"words/{names[i]}", narrow(counts), *sums)
        return Round(path, c, names[i], 1).write(), 0

    grams = sum(x for x, _ in each(spark, chunks, begin))
    for m in range(1, DEPTH + 1):
        drop(path, f"answers-{m - 1}")
        parts = ask(m, grams)

        def go(i: int, m=m, parts=parts) -> tuple[int, int]:
            c = Chunk(path, names[i])
            Round(path, c, names[i], m).settle(i, parts, total, distinct)
            return (Round(path, c, names[i], m + 1).write(), 0) if m < DEPTH else (0, 0)

        grams = sum(x for x, _ in each(spark, chunks, go))
        drop(path, f"state-{m - 1}")
    drop(path, f"answers-{DEPTH}")

    def first(i: int) -> tuple[int, int]:
        return Search.load(path, 0, names[i]).write(path, 0, names[i]), 0

    left, r = sum(x for x, _ in each(spark, chunks, first)), 0
    while left:
        parts = max(1, min(BUCKETS, -(-left // part_grams)))

        def look(p: int, r=r, parts=parts) -> tuple[int, int]:
            find(path, r, names, p, parts)
            return 0, 0

        def go_on(i: int, r=r, parts=parts) -> tuple[int, int]:
            if not stored(path, f"search-{r + 1}/{names[i]}"):  # the last to be written, if the task ran before
                s = Search.load(path, r, names[i]).take(path, r, names[i], i, parts)
                s.write(path, r + 1, names[i])
                s.save(path, r + 1, names[i])
            for old in ("turns", "search"):
                drop(path, f"{old}-{r}/{names[i]}")
            with Stored(path, f"turns-{r + 1}/{names[i]}") as f:
                return int(f.head[0, 1] + f.head[3, 1]), int(f.head[3, 1])

        each(spark, parts, look)
        drop(path, f"tries-{r}")
        sums = each(spark, chunks, go_on)
        left = sum(x for x, _ in sums) if any(y for _, y in sums) else 0
        for old in ("turns", "found", "search"):
            drop(path, f"{old}-{r}")
        r += 1

    def close(i: int) -> tuple[int, int]:
        add_up(path, r, names[i], total, distinct)
        return 0, 0

    each(spark, chunks, close)
    for old in (f"tries-{r}", f"turns-{r}", f"search-{r}", f"state-{DEPTH}", "places"):
        drop(path, old)

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                with Stored(path, f"chunk/{names[i]}") as f:
                    n, keys = f.read(2), _keys(f)
                _, known, base = load(path, f"words/{names[i]}")
                scores = load(path, f"score/{names[i]}")[0]
                yield pa.RecordBatch.from_arrays(
                    [keys, *map(pa.array, (n, known, base, scores))],
                    names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
                )

    kind = src.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double"
    return spark.range(0, chunks, 1, chunks).mapInArrow(result, schema), total
