"""Toxicity scores: boosted trees over dense text features, calibrated by isotonic regression.

A lexicon of common insults is widened by words and word beginnings that the
training labels single out (by a likelihood ratio), so that other languages
are covered.  Each half of the training rows gets its features from what was
mined on the other half; the final features use all of it.  Fitting works on
a bounded sample of labelled rows, of which only counts and feature vectors
reach the driver; scoring is one pass over the table without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkhist.llm._common import crc_mod, materialize, one_text_each, sliced

#: Labelled rows to learn from, at most; the smallest by hash of their id.
SAMPLE = 12_000
#: Least documents and likelihood ratio of a mined term.
LEAST_DOCS, LEAST_RATIO = 3, 12.0
#: From this score on a document counts as toxic.
THRESHOLD = 0.3

INSULTS = frozenset(
    """arse arsehole ass asshole bastard bitch bonehead braindead bugger clown coward creep cretin crap cunt damn
    deadbeat degenerate despicable dick dimwit dipshit disgrace disgusting dolt donkey dork douche douchebag dumb
    dumbass dunce fag faggot failure filth filthy fool freak fuck fucker fucking garbage goon gross halfwit hag hate
    hideous hypocrite idiot idiotic idiots ignorant imbecile incompetent inferior jackass jerk kill knucklehead lame
    leech liar lowlife loser losers lunatic maggot maniac mongrel monster moron moronic morons motherfucker nasty
    nitwit numbskull nutjob oaf obnoxious parasite pathetic peasant pervert pest pig pigs piss pissed prick pussy rat
    reject repulsive retard retarded rotten rubbish savage scoundrel scum scumbag shit shithead shitty shut sicko
    simpleton slag slime slut snake sod spineless stinking stupid stupidity subhuman sucker sucks swine thug tosser
    traitor tramp trash troll twat twit ugly useless vermin vile wanker weakling weirdo whore wicked wimp witch
    worthless wretch wretched
    abruti andouille batard bouffon conard connard connasse cretin debile encule imbecile merde minable ordure pourri
    putain salaud salope arschloch bloedmann depp drecksau dummkopf hurensohn idiotin mistkerl schlampe schwachkopf
    schwein trottel versager wichser cabron estupido gilipollas hijoputa idiota imbecil maricon mierda pendejo puta
    puto tonto zorra""".split()
)
YOU = frozenset(
    "you your youre yours yourself u ur ya du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos "
    "usted ustedes vosotros tú ti tuyo vuestro".split()
)
WORDS = re.compile(r"[^\W\d_]+")
MIXED = re.compile(r"(?<!\S)\S*[^\W\d_][0-9@$*!|+]+[^\W\d_]\S*")
CAPS = re.compile(r"\b[A-Z]{3,}\b")
SYMBOL = re.compile(r"[^\w\s.,;:'\"()-]")
PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"})
NAMES = (
    "listed", "listed_rate", "mined", "mined_rate", "roots", "roots_rate", "any", "any_rate", "crowded", "at_you",
    "capitals", "shouted", "exclaims", "symbols", "mixed", "hidden", "words", "distinct",
)


@dataclass
class Lexicon:
    """Mined words and, by length, mined beginnings."""

    words: frozenset = frozenset()
    roots: dict[int, frozenset] = field(default_factory=dict)


def terms(text: str | None) -> set[str]:
    """What mining counts: words, and beginnings of 4 to 6 letters marked by their length."""
    out = set()
    for w in set(WORDS.findall((text or "").lower())):
        if len(w) >= 4:
            out.add(w)
            out.update(f"{k}{w[:k]}" for k in (4, 5, 6) if len(w) > k)
    return out


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The dense vector of NAMES; zeros for a text without words."""
    text = text or ""
    words = WORDS.findall(text.lower())
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    seen = set(words)
    listed, mined = seen & INSULTS, seen & lexicon.words
    roots = {w for w in seen if any(w[:k] in r and len(w) > k for k, r in lexicon.roots.items())}
    hits, at_you, crowded = [], 0, 0
    bad = listed | mined | roots
    n_listed = n_mined = n_roots = 0
    if bad:
        hits = [i for i, w in enumerate(words) if w in bad]
        for i in hits:
            w = words[i]
            n_listed += w in listed
            n_mined += w in mined
            n_roots += w in roots
            at_you += any(x in YOU for x in words[max(0, i - 5) : i + 6])
        lo = 0
        for hi, i in enumerate(hits):
            while i - hits[lo] > 50:
                lo += 1
            crowded = max(crowded, hi - lo + 1)
    letters = sum(map(len, words))
    upper = sum(map(len, re.findall(r"[A-Z]+", text)))
    odd = MIXED.findall(text)
    hidden = 0
    for x in odd:
        y = re.sub(r"[^a-z]", "", x.lower().translate(PLAIN))
        hidden += y in INSULTS or y in lexicon.words
    per = 100.0 / n
    return [
        n_listed, n_listed * per, n_mined, n_mined * per, n_roots, n_roots * per, len(hits), len(hits) * per, crowded,
        at_you, upper / max(1, letters), len(CAPS.findall(text)) * per, text.count("!") * per,
        len(SYMBOL.findall(text)) * per, len(odd) * per, hidden, float(np.log1p(n)), len(seen) / n,
    ]


class Trees:
    """Gradient-boosted regression trees for the logistic loss, on binned features."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, l2: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        for j, c in enumerate(x.T):  # a rare positive value still gets a cut
            if (c > 0).any():
                self.cuts[j] = np.unique(np.append(self.cuts[j], c[c > 0].min() / 2))
        b = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T)], 1)
        wide = max(len(c) for c in self.cuts) + 1
        p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p0 / (1 - p0)))
        score = np.full(len(y), self.start)
        self.trees: list[list[tuple]] = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), np.int64)
            tree = []
            for level in range(self.depth):
                m = 1 << level
                best_gain = np.full(m, 1e-6)
                best = [(0, wide)] * m  # everything goes left
                gsum, hsum = np.bincount(node, g, m), np.bincount(node, h, m)
                parent = gsum**2 / (hsum + self.l2)
                for j in range(x.shape[1]):
                    key = node * wide + b[:, j]
                    gl = np.cumsum(np.bincount(key, g, m * wide).reshape(m, wide), 1)[:, :-1]
                    hl = np.cumsum(np.bincount(key, h, m * wide).reshape(m, wide), 1)[:, :-1]
                    gain = gl**2 / (hl + self.l2) + (gsum[:, None] - gl) ** 2 / (hsum[:, None] - hl + self.l2)
                    gain -= parent[:, None]
                    at = gain.argmax(1)
                    for k in range(m):
                        if gain[k, at[k]] > best_gain[k]:
                            best_gain[k], best[k] = gain[k, at[k]], (j, int(at[k]))
                tree.append(best)
                js = np.array([s[0] for s in best])[node]
                ts = np.array([s[1] for s in best])[node]
                node = 2 * node + (b[np.arange(len(y)), js] > ts)
            m = 1 << self.depth
            leaf = -self.rate * np.bincount(node, g, m) / (np.bincount(node, h, m) + self.l2)
            score += leaf[node]
            self.trees.append((tree, leaf))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T)], 1)
        score = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for tree, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for best in tree:
                s = np.array(best)
                node = 2 * node + (b[rows, s[node, 0]] > s[node, 1])
            score += leaf[node]
        return score


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the monotone fit of y on x: equal x are averaged, then adjacent violators pooled."""
    at, inverse, n = np.unique(x, return_inverse=True, return_counts=True)
    mean = np.bincount(inverse, y, len(at)) / n
    blocks: list[list[float]] = []  # mean of y, weight, mean of x
    for a, b, weight in zip(at.tolist(), mean.tolist(), n.tolist()):
        blocks.append([b, float(weight), a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w, u = blocks.pop()
            blocks[-1] = [
                (blocks[-1][0] * blocks[-1][1] + v * w) / (blocks[-1][1] + w),
                blocks[-1][1] + w,
                (blocks[-1][2] * blocks[-1][1] + u * w) / (blocks[-1][1] + w),
            ]
    return np.array([b[2] for b in blocks]), np.array([b[0] for b in blocks])


@dataclass
class Model:
    """What scoring needs; small, and sent with the tasks."""

    lexicon: Lexicon
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.prior)
        raw = self.trees.raw(x)
        smooth = 1 / (1 + np.exp(-raw))
        # A trace of the raw score orders what isotonic steps tie.
        return np.clip(0.999 * np.interp(raw, *self.knots) + 0.001 * smooth, 0.0, 1.0)


def _sampled(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, sample: int) -> DataFrame:
    """(text, y, fold) of at most `sample` labelled rows outside the held-out quarter.

    An id with several labels counts as toxic if one of them says so; of its
    several texts one is learned from.
    """
    ids = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (crc_mod(id_col, 4) != 2))
        .groupBy(F.col(id_col).alias("_tx_id")).agg((F.max(label) > 0).cast("int").alias("y"))
        .orderBy(F.xxhash64("_tx_id"), "_tx_id").limit(sample)
    )
    ids = materialize(ids, "sampled")
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fold = (F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 4) % 2).cast("int")
    rows = src.join(F.broadcast(ids), src["doc_id"] == ids["_tx_id"])
    return one_text_each(rows.select("doc_id", "text", "y"), "doc_id").select("text", "y", fold.alias("fold"))


def _accepted(folds: tuple[int, ...], size: dict[tuple[int, int], int]) -> Column:
    """True for terms that `_lexicon` takes from these folds; the ratio has some slack for rounding."""
    clean_docs, toxic_docs = (sum(size.get((f, y), 0) for f in folds) for y in (0, 1))
    if not toxic_docs:
        return F.lit(False)
    a, b = (sum((F.col(f"n{2 * f + y}") for f in folds), F.lit(0)) for y in (1, 0))
    share = (a + b) / float(clean_docs + toxic_docs)
    rest = F.when(b > 0, b * F.log(b / (share * float(max(1, clean_docs))))).otherwise(0.0)
    ratio = 2 * (F.when(a > 0, a * F.log(a / (share * float(toxic_docs)))).otherwise(0.0) + rest)
    least = LEAST_RATIO if len(folds) > 1 else LEAST_RATIO / 2
    return (a / float(toxic_docs) > 4 * b / float(max(1, clean_docs)) - 1e-12) & (ratio >= least - 1e-6)


def _mine(rows: DataFrame, size: dict[tuple[int, int], int]) -> list[tuple[str, list[int]]]:
    """Terms with documents by fold and label, those that a lexicon takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 10_000):
            counts: Counter = Counter()
            for text, y, fold in zip(b.column("text"), b.column("y").to_pylist(), b.column("fold").to_pylist()):
                k = 2 * fold + y
                counts.update((t, k) for t in terms(text.as_py()))
            keys = list(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.string()),
                    pa.array([k[1] for k in keys], pa.int32()),
                    pa.array([counts[k] for k in keys], pa.int64()),
                ],
                names=["term", "k", "n"],
            )

    by = [F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(4)]
    found = rows.mapInArrow(run, "term string, k int, n long").groupBy("term").agg(*by)
    toxic = F.col("n1") + F.col("n3")
    taken = _accepted((0,), size) | _accepted((1,), size) | _accepted((0, 1), size)
    # How many there can be is bounded by the sample, as each takes LEAST_DOCS toxic documents.
    found = found.where((toxic >= LEAST_DOCS) & taken).orderBy("term")
    return [(r.term, [r.n0, r.n1, r.n2, r.n3]) for r in found.collect()]


def _lexicon(found: list[tuple[str, list[int]]], folds: tuple[int, ...], size: dict[tuple[int, int], int]) -> Lexicon:
    clean_docs = sum(size.get((f, 0), 0) for f in folds)
    toxic_docs = sum(size.get((f, 1), 0) for f in folds)
    words, roots = set(), {4: set(), 5: set(), 6: set()}
    for term, n in found:
        a, b = sum(n[2 * f + 1] for f in folds), sum(n[2 * f] for f in folds)
        if a < min(LEAST_DOCS, 3 if len(folds) > 1 else 2) or not toxic_docs:
            continue
        share = (a + b) / (clean_docs + toxic_docs)
        ratio = 2 * (a * np.log(a / (share * toxic_docs)) + (b * np.log(b / (share * clean_docs)) if b else 0.0))
        if a / toxic_docs > 4 * b / max(1, clean_docs) and ratio >= (LEAST_RATIO if len(folds) > 1 else LEAST_RATIO / 2):
            if term[0].isdigit():
                roots[int(term[0])].add(term[1:])
            else:
                words.add(term)
    return Lexicon(frozenset(words), {k: frozenset(v) for k, v in roots.items()})


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = SAMPLE,
) -> Model:
    """Learn from at most `sample` labelled rows whose crc32(id as text) mod 4 isn't 2.

    Without rows of both labels the score is a constant, the share of label
    1 (0 without any).  Rows without label or id teach nothing.
    """
    rows = materialize(_sampled(docs, labels, label, id_col, text_col, sample), "training")
    size = {(r.fold, r.y): r["count"] for r in rows.groupBy("fold", "y").count().collect()}
    total, toxic = sum(size.values()), sum(v for (_, y), v in size.items() if y)
    if not toxic or toxic == total:
        return Model(Lexicon(), None, (np.zeros(1), np.zeros(1)), toxic / total if total else 0.0)
    found = _mine(rows, size)
    other = {0: _lexicon(found, (1,), size), 1: _lexicon(found, (0,), size)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            folds = b.column("fold").to_pylist()
            x = [features(t.as_py(), other[f]) for t, f in zip(b.column("text"), folds)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.list_(pa.float64())), b.column("y")], names=["x", "y"]
            )

    got = rows.mapInArrow(run, "x array<double>, y int").toArrow()
    x, y = np.array(got.column("x").to_pylist()), np.array(got.column("y").to_pylist(), float)
    order = np.lexsort((*x.T, y))  # the same whatever partition rows came from
    x, y = x[order], y[order]
    part = np.random.default_rng(0).integers(0, 3, len(y))
    held = np.zeros(len(y))
    for k in range(3):
        train = part != k
        held[~train] = Trees().fit(x[train], y[train]).raw(x[~train]) if (~train).any() else 0
    return Model(_lexicon(found, (0, 1), size), Trees().fit(x, y), isotonic(held, y), toxic / total)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.

    A null text counts as empty; a null id isn't held out; repeated rows each
    get a line; other columns are not read; an empty table gives no line.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            x = np.array([features(t.as_py(), model.lexicon) for t in b.column("text")]).reshape(-1, len(NAMES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    out = src.mapInArrow(run, f"doc_id {kind}, score double")
    return out.select(
        "doc_id",
        F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that score below `threshold`, in one pass without a join.

    All columns stay, whatever their names; a null text counts as empty;
    repeated rows go or stay together; an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = b.column(b.schema.get_field_index(text_col))
            x = np.array([features(t.as_py(), model.lexicon) for t in texts]).reshape(-1, len(NAMES))
            yield b.filter(pa.array(model.score(x) < threshold))

    return docs.mapInArrow(run, docs.schema)


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model fitted on their labels."""
    return score(docs, fit(docs, labels))
