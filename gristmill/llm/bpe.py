"""Byte-level BPE over a fixed vocabulary of ranks.

The vocabulary's bytes are mapped to Latin-1 for an Aho-Corasick automaton. A piece of text is
encoded from the left with the longest token that matches, checked against the token before it:
two tokens may stand side by side only if merging by rank would leave them so, which a memo answers.
Where the pair may not stand, the next shorter prefix token is tried, then the step before is taken
back. Each position is given up at most once, so the work is linear in the piece, and the result is
that of the merges themselves. As long as all longest tokens may stand, one scan of the automaton gives them.

Pieces recur, so a bounded memo holds the ids of short ones, in two generations: what is asked for while the younger one
fills is kept, the rest goes. Nulls are empty texts; an
empty text has no ids. Texts and pieces of any length are encoded whole and need no more than linear time and memory. Lone surrogates
cannot occur in Spark strings. Of merges with equal rank the leftmost is done first. Repeated rows and ids are encoded each, an empty table gives an empty
result. Other columns pass through encode and decode, but for ids, n_tokens and decoded, which are replaced; encode_digests reads only doc_id and text.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMO_PIECES, MEMO_PAIRS, MEMO_BYTES = 150_000, 300_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Memo(dict):
    """The ids of pieces as 32-bit numbers, encoded when they are asked for first. A full generation becomes the older one, and what is asked for again comes back from there."""

    def __init__(self, encode: Callable[[bytes], list[int]]):
        self.encode, self.older = encode, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("i", self.encode(piece.encode())).tobytes()
            if len(piece) > MEMO_BYTES:
                return ids
        if len(self) >= MEMO_PIECES // 2:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """Exact BPE for one vocabulary (every single byte must be a token)."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks, self.tokens = ranks, {r: b for b, r in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for b, r in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), r)
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int | None] = {}
        self.parts: dict[int, tuple[int, int] | None] = {}
        # by rank
        at = range(max(self.tokens) + 1)
        self.bytes_of = pa.array([self.tokens.get(r) for r in at], pa.large_binary())
        self.decimals = pa.array([b",%d" % r for r in at], pa.large_binary())
        self.sizes = [len(self.tokens.get(r, b"")) for r in at]
        self.width = max(self.sizes)
        self.memo = Memo(self.encode_piece)
        # in order of rank, so that a token's parts are known before any token that is made of it
        for r in sorted(self.tokens):
            self.parts[r] = self._parts(r)
        self.usable = [r in self.tokens and self.made(r) for r in at]
        for r in self.tokens:
            self.prefix(r)

    def prefix(self, token: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        if token not in self.shorter:
            b = self.tokens[token]
            self.shorter[token] = next((self.ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.ranks), None)
        return self.shorter[token]

    def _parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte or what merges never make."""
        b, left = self.tokens[token], self.prefix(token)
        while left is not None:
            right = self.ranks.get(b[len(self.tokens[left]) :])
            if right is not None and left < token and right < token and self.fit(left, right, token):
                return left, right
            left = self.prefix(left)
        return None

    def made(self, token: int) -> bool:
        return len(self.tokens[token]) == 1 or self.parts.get(token) is not None

    def fit(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether merges leave left and right side by side: no merge across the border comes first.

        Going back through both tokens' merges, the latest first, the border's two neighbours must
        not form a token of a rank lower than the merge that used one of them up.
        """
        key = (left, right)
        if below is None and (known := self.compatible.get(key)) is not None:
            return known
        limit, out = (1 << 62) if below is None else below, True
        a, b = left, right
        while True:
            joined = self.ranks.get(self.tokens[a] + self.tokens[b])
            # on equal rank the merge further left is done first
            if joined is not None and joined < limit and (joined in self.parts and self.parts[joined] is not None):
                out = False
                break
            pa_, pb = self.parts.get(a), self.parts.get(b)
            if pa_ is None and pb is None:
                break
            if pb is None or (pa_ is not None and a > b):
                limit, a = a, pa_[1]
            else:
                limit, b = b + 1, pb[0]
        if below is None:
            if len(self.compatible) > MEMO_PAIRS:
                self.compatible.clear()
            self.compatible[key] = out
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        """As merging by rank would; a piece that is a token is that token."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n, text = len(piece), piece.decode("latin-1")
        scan, sizes, usable, shorter, compatible = self.automaton.iter_long, self.sizes, self.usable, self.shorter, self.compatible
        out: list[int] = []
        at, last = 0, None
        for _, token in scan(text):
            if not usable[token] or not (last is None or (self.fit(last, token) if (known := compatible.get((last, token))) is None else known)):
                break
            out.append(token)
            at += sizes[token]
            last = token
        else:
            return out
        dead = bytearray(n + 1)
        while True:
            end = at + sizes[token]
            if not dead[end] and usable[token] and (last is None or (self.fit(last, token) if (known := compatible.get((last, token))) is None else known)):
                out.append(token)
                if end == n:
                    return out
                at, last = end, token
                _, token = next(scan(text[at : at + self.width]))
                continue
            token = shorter[token]
            while token is None:
                dead[at] = 1
                last = out.pop()
                at -= sizes[last]
                token = shorter[last]
                last = out[-1] if out else None

    def encode(self, pieces: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.memo.__getitem__, pieces)), np.int32)

    def decode(self, ids: np.ndarray) -> pa.Buffer | bytes:
        return joined(self.bytes_of, ids)

    def decimal(self, ids: np.ndarray) -> memoryview:
        """The ids in decimal, commas between them."""
        return memoryview(joined(self.decimals, ids))[1:]


def joined(texts: pa.Array, ids: np.ndarray) -> pa.Buffer | bytes:
    """The texts of the ids, one after the other: as Arrow lays them out."""
    if not len(ids):
        return b""
    taken = texts.take(pa.array(ids))
    if taken.null_count:
        raise KeyError("an id that is no token")
    _, ends, data = taken.buffers()
    return data.slice(0, int(np.frombuffer(ends, np.int64)[len(ids)]))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    import regex

    return Encoder(read_ranks(path)), regex.compile(pattern)


def vocabulary(path: str) -> str:
    """The vocabulary where a task finds it: as installed, or as sent with the job."""
    import os

    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def encode(documents: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """documents with n_tokens and ids (array of int) of every whole text."""

    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        own, pieces = encoder(vocabulary(path), pattern)
        return pa.array([own.encode(pieces.findall(t.as_py() or "")) for t in texts], pa.list_(pa.int32()))

    return documents.withColumn("ids", ids_of(text)).withColumn("n_tokens", F.size("ids").cast("long"))


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """rows with decoded (binary), the bytes of the ids."""

    @F.arrow_udf("binary")
    def bytes_of(lists: pa.Array) -> pa.Array:
        own, _ = encoder(vocabulary(path), pattern)
        return pa.array([bytes(own.decode(np.array(x.as_py() or [], np.int32))) for x in lists], pa.binary())

    return rows.withColumn("decoded", bytes_of(ids))


def encode_digests(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids and of what they decode to, without shipping ids between processes."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pieces = encoder(vocabulary(path), pattern)
        sha = hashlib.sha256
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column(1):
                ids = own.encode(pieces.findall(t.as_py() or ""))
                n.append(len(ids))
                a.append(sha(own.decimal(ids)).hexdigest())
                b.append(sha(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
