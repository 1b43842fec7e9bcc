"""Token counts of byte-level BPE, exact at every prefix.

For a BPE vocabulary a token sequence is the encoding of its bytes exactly if
every neighbouring pair is.  So the last token of the encoding of a prefix is
the one vocabulary entry ``t`` that ends there and forms a valid pair with the
last token of the prefix before it, and

    count[p] = count[p - len(t)] + 1.

`PrefixCounter` runs this dynamic program over each distinct pre-token once
and keeps the table.  The counts at all prefixes of a text follow by adding
those of its pre-tokens and are stored as compressed differences, so
truncation and budget questions are answered by looking up an array, without
encoding again.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from operator import sub

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkhist.llm._common import sliced

#: The published pattern that splits text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts without two white-space characters in a row.
PLAIN = PATTERN.replace(r"\s+(?!\S)|\s+", r"\s")
#: Entries a worker keeps before its caches start afresh.
CACHE = 400_000
LONGEST_KEY = 64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(bytes of a token -> id, special string -> id) of a byte-level BPE file.

    Raises ValueError if ids don't follow the order of merges, on which the
    encoder relies.
    """
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    special = {t["content"]: t["id"] for t in d.get("added_tokens", [])}
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in k): v for k, v in d["model"]["vocab"].items() if k not in special}
    last = -1
    for m in d["model"]["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        rank = ranks[bytes(letters[c] for c in a + b)]
        if rank <= last:
            raise ValueError("token ids don't follow the order of merges")
        last = rank
    return ranks, special


class Encoder:
    """Ids of whole texts.

    Texts without two white-space characters in a row, nearly all, are split
    by a pattern that needs no look-ahead and gives the same pieces there.
    """

    def __init__(self, path: str | None = None):
        import tiktoken

        self.ranks, self.special = load_vocabulary(path or default_path())
        make = lambda name, pattern: tiktoken.Encoding(
            name, pat_str=pattern, mergeable_ranks=self.ranks, special_tokens=self.special
        )
        self.bpe, self.plain = make("full", PATTERN), make("plain", PLAIN)
        self.allowed = set(self.special)
        self.runs = re.compile(r"\s\s")

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.bpe.encode(text, allowed_special=self.allowed, disallowed_special=())
        return (self.bpe if self.runs.search(text) else self.plain).encode_ordinary(text)

    def ids_bytes(self, text: str) -> bytes:
        """The ids of `text` as little-endian unsigned 32-bit integers."""
        a = array("I", self.ids(text))
        if sys.byteorder == "big":
            a.byteswap()
        return a.tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """One encoder per worker process and file."""
    key = path or default_path()
    if key not in _encoders:
        _encoders[key] = Encoder(key)
    return _encoders[key]


class _Known(dict):
    """Values by text, made when they are first asked for; those of long texts aren't kept."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, text: str):
        value = self.make(text)
        if len(text) <= LONGEST_KEY:
            if len(self) >= CACHE:
                self.clear()
            self[text] = value
        return value


class PrefixCounter:
    """Token counts at every byte prefix of a text."""

    def __init__(self, path: str | None = None):
        self.enc = encoder(path)
        self.ranks = self.enc.ranks
        self.begins = {t[:i] for t in self.ranks for i in range(1, len(t) + 1)}
        self.split = regex.compile(PATTERN)
        self.tables: dict[str, list[int] | bytes] = {}
        self.words = _Known(self._word)
        self.pieces = _Known(self._piece)
        self.pairs: dict[tuple[bytes, bytes], bool] = {}

    def _valid(self, a: bytes, b: bytes) -> bool:
        """Whether two tokens in a row are the encoding of their bytes."""
        key = (a, b)
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            ok = self.pairs[key] = self.enc.bpe._encode_single_piece(a + b) == [self.ranks[a], self.ranks[b]]
        return ok

    def table(self, piece: str) -> list[int] | bytes:
        """Counts at the byte prefixes 1.. of one pre-token."""
        known = self.tables.get(piece)
        if known is not None:
            return known
        s = piece.encode()
        n = len(s)
        ranks, begins, valid = self.ranks, self.begins, self._valid
        last: list[bytes] = [b""] * (n + 1)
        count = [0] * (n + 1)
        for q in range(n):
            before, c = last[q], count[q] + 1
            for p in range(q + 1, n + 1):
                t = s[q:p]
                if t not in begins:
                    break
                # One token alone ends each prefix's encoding, so the first that fits is it.
                if not count[p] and t in ranks and (not q or valid(before, t)):
                    last[p], count[p] = t, c
        if not all(count[1:]):
            raise ValueError("the vocabulary lacks a byte")
        if n > LONGEST_KEY:
            return count[1:]
        if len(self.tables) >= CACHE:
            self.tables.clear()
        out = self.tables[piece] = bytes(count[1:])
        return out

    def _piece(self, piece: str) -> bytes | bool:
        """Differences of the counts at the prefixes of one pre-token, as signed bytes; False if one doesn't fit."""
        counts = self._counts(piece)
        steps = [counts[0], *map(sub, counts[1:], counts)]
        return max(steps) < 128 and min(steps) >= -128 and array("b", steps).tobytes()

    def _counts(self, piece: str) -> list[int] | bytes:
        """`table`, but for prefixes of a contraction, which are two pre-tokens until it is complete."""
        counts = self.table(piece)
        if len(piece) > 2 and piece[0] == "'" and piece[1:].isalpha():
            counts = list(counts)
            for i in range(2, len(piece)):
                counts[i - 1] = sum(self.table(x)[-1] for x in self.split.findall(piece[:i]))
        return counts

    def _word(self, word: str) -> bytes | bool:
        """`steps` of what stands between two single spaces as signed bytes; False if one doesn't fit."""
        parts = list(map(self.pieces.__getitem__, self.split.findall(word)))
        return b"".join(parts) if all(parts) else not parts and b""

    def steps(self, text: str) -> np.ndarray:
        """Differences of `prefix_counts`, one for each byte; their sum is the count of the whole text."""
        if not (
            self.enc.runs.search(text) or text[:1].isspace() or text[-1:].isspace() or "\0" in text
            or any(s in text for s in self.enc.special)
        ):
            # A single space between other characters starts a pre-token, so words count apart.
            words = text.replace(" ", "\0 ").split("\0")
            try:
                return np.frombuffer(b"".join(map(self.words.__getitem__, words)), np.int8)
            except TypeError:  # a difference that isn't a byte
                pass
        return np.diff(self.prefix_counts(text))

    def _parts(self, text: str) -> list[str]:
        """The text cut around special strings, those included."""
        if not any(s in text for s in self.enc.special):
            return [text]
        cut = regex.compile("(" + "|".join(regex.escape(s) for s in self.enc.special) + ")")
        return cut.split(text)

    def count(self, text: str) -> int:
        """Tokens of a whole text: the last entry of `prefix_counts`."""
        return int(self.steps(text).sum(dtype=np.int64))

    def prefix_counts(self, text: str) -> np.ndarray:
        """counts[p]: tokens of the first p bytes; p = 0 .. n_bytes.

        Exact wherever a prefix ends between characters; inside a character
        it counts the bytes so far.
        """
        out: list[int] = [0]
        base = 0
        tail: list[str] = []  # the last pieces since a special string
        for part in self._parts(text):
            if part in self.enc.special:
                # Until it is complete its beginning is ordinary text, which changes the last piece at most.
                start = base - sum(self.table(x)[-1] for x in tail)
                for i in range(1, len(part)):
                    out.append(start + sum(self.table(x)[-1] for x in self.split.findall("".join(tail) + part[:i])))
                base += 1
                out.append(base)
                tail = []
                continue
            before = ""
            pieces = self.split.findall(part)
            tail = pieces[-2:]
            for piece in pieces:
                counts = self._counts(piece)
                at = [base + c for c in counts]
                head = len(piece[0].encode())
                if before and before.isspace() and piece[0].isspace():
                    # A prefix that ends here is one run of white space.
                    run = self.table(before + piece[0])
                    start = base - self.table(before)[-1]
                    at[:head] = [start + c for c in run[-head:]]
                out.extend(at)
                base += counts[-1]
                before = piece
        return np.asarray(out, np.int64)


_counters: dict[str, PrefixCounter] = {}


def prefix_counter(path: str | None = None) -> PrefixCounter:
    key = path or default_path()
    if key not in _counters:
        _counters[key] = PrefixCounter(key)
    return _counters[key]


def longest_within(counts: np.ndarray, budget: int) -> int:
    """The longest prefix, in bytes, of at most `budget` tokens, from `prefix_counts`."""
    return int(np.flatnonzero(counts <= budget)[-1])


def pack_prefixes(steps: np.ndarray) -> bytes:
    """Compressed prefix counts: the width of a difference in bytes, then all differences by zlib."""
    width = 1 if steps.dtype == np.int8 or (np.abs(steps) < 128).all() else 4
    return bytes([width]) + zlib.compress(steps.astype(f"<i{width}").tobytes(), 1)


def read_prefixes(blob: bytes) -> np.ndarray:
    """The counts at the byte prefixes 0 .. n_bytes in a ``prefix_counts`` value; see `longest_within`."""
    steps = np.frombuffer(zlib.decompress(blob[1:]), f"<i{blob[0]}")
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


def token_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 1024,
    path: str | None = None,
    with_prefixes: bool = True,
) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit (more than `limit` tokens), prefix_counts.

    ``prefix_counts`` holds the exact count at every byte prefix, compressed;
    `read_prefixes` and `longest_within` answer truncation and budget
    questions from it without encoding again.  The count of a text is that at
    its last prefix.  Without ``with_prefixes`` the column is left out.
    Nothing is shuffled.  A null text counts as empty (0 tokens); repeated
    rows each get a row; a null id stays null; other columns are not read; an
    empty table gives no row.
    """
    path = path or default_path()
    cols = [F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    src = docs.select(*cols)
    kind = src.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    schema += ", prefix_counts binary" if with_prefixes else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = prefix_counter(path)
        for b in sliced(batches):
            size, n, blobs = [], [], []
            for t in b.column("text"):
                steps = c.steps(t.as_py() or "")
                size.append(len(steps))
                n.append(int(steps.sum(dtype=np.int64)))
                if with_prefixes:
                    blobs.append(pack_prefixes(steps))
            over = pa.array([x > limit for x in n], pa.bool_())
            cols = [b.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), over]
            names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            if with_prefixes:
                cols.append(pa.array(blobs, pa.binary()))
                names.append("prefix_counts")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return src.mapInArrow(run, schema)
