"""Byte-level BPE encoding and decoding by segment trees.

The text is split by the vocabulary's pattern. A piece that is a token is that token. In any other piece every byte position is a leaf of a
segment tree that stores the rank of the pair that begins there; an inner node stores the least (rank, position) below it, so the root names
the leftmost pair of least rank. A merge writes three leaves (the pair itself, the neighbour it swallowed, and the live neighbour on the left)
and repairs their paths: logarithmic work, also for a piece of a million bytes. Short pieces are merged many at a time, one tree a row of an array.

Pieces repeat, so each task keeps the ids of pieces, up to ``CACHE`` bytes in all. Rows are independent: no shuffle. Memory is bounded by a
slice of about 1 MB of text; a longer text is read piece by piece and its digests are updated as it goes.

Defined results: null counts as empty and has no tokens; special tokens aren't known, their strings are ordinary text; repeated rows are
each encoded; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import KEPT, SLICE, U, mix, release, slices
from .tables import only, table

CACHE = 32 << 20  # bytes of what a task keeps, with about 200 a piece for the objects
NONE = (1 << 62) - 1
POS = 24  # bits of a position in a node of the arrays
WIDE = 64  # longer pieces get a tree of their own
_SPACES = "\t\n\x0b\f\r \x85\xa0  -     　"


def compile_pattern(pattern: str) -> regex.Pattern:
    """The pattern with its white space classes spelt out as Unicode's White_Space, whatever the library takes for it."""
    spelt = pattern.replace(r"[^\s", f"[^{_SPACES}").replace(r"\S", f"[^{_SPACES}]").replace(r"\s", f"[{_SPACES}]")
    return regex.compile(spelt)


class Vocabulary:
    """Ranks of a rank file; ids are ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.pattern = compile_pattern(pattern)
        self.pairs = {
            (self.ranks[t[:i]], self.ranks[t[i:]]): r
            for t, r in self.ranks.items()
            for i in range(1, len(t))
            if t[:i] in self.ranks and t[i:] in self.ranks
        }
        bits = max(4, (4 * len(self.pairs)).bit_length())
        self._mask = (1 << bits) - 1
        self._keys = np.full(1 << bits, -1, dtype=np.int64)
        self._values = np.full(1 << bits, NONE, dtype=np.int64)
        for (a, b), r in self.pairs.items():
            key = a << 32 | b
            at = _slot(key) & self._mask
            while self._keys[at] != -1:
                at = (at + 1) & self._mask
            self._keys[at], self._values[at] = key, r
        self.known: dict[str, bytes] = {}
        self.held = 0

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the merged pairs, ``NONE`` where the vocabulary has no such token."""
        key = (left << 32) | right
        at = (mix(key.view(U)) & U(self._mask)).astype(np.int64)
        out = np.full(len(key), NONE, dtype=np.int64)
        open_ = np.arange(len(key))
        while len(open_):
            found = self._keys[at]
            hit = found == key
            out[open_[hit]] = self._values[at[hit]]
            more = ~hit & (found != -1)
            open_, at, key = open_[more], (at[more] + 1) & self._mask, key[more]
        return out

    def encode_pieces(self, pieces: Iterable[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian 32-bit integers."""
        pieces = list(pieces)
        out: list[bytes] = [b""] * len(pieces)
        classes: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(piece) > WIDE:
                out[i] = np.array(_merge_long(piece, self), dtype="<u4").tobytes()
            else:
                classes.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, members in classes.items():
            for at in range(0, len(members), 8192):
                block = members[at : at + 8192]
                for i, ids in zip(block, _merge_many([pieces[i] for i in block], width, self), strict=True):
                    out[i] = ids
        return out

    def learn(self, words: set[str]) -> None:
        """Puts the ids of all these pieces into the cache, together."""
        known = self.known
        missing = [w for w in words if w not in known]
        if missing:
            size = sum(map(len, missing)) * 5 + 200 * len(missing)
            if self.held + size > CACHE:
                known.clear()
                missing = list(words)
                self.held, size = 0, sum(map(len, missing)) * 5 + 200 * len(missing)
            self.held += size
            known.update(zip(missing, self.encode_pieces([w.encode() for w in missing]), strict=True))

    def forget(self) -> None:
        """Empties the cache at the end of a task: a worker that waits for its next one keeps the ranks alone."""
        self.known.clear()
        self.held = 0
        release()

    def ids(self, words: list[str]) -> bytes:
        self.learn(set(words))
        return b"".join(map(self.known.__getitem__, words))

    def encode_all(self, texts: list[bytes]) -> Iterator[Iterator[bytes]]:
        """For each text the parts of its ids; short texts' unknown pieces are merged together."""
        if sum(map(len, texts)) > 4 * SLICE:
            yield from (self.encode(t.decode()) for t in texts)
            return
        words = [self.pattern.findall(t.decode()) for t in texts]
        self.learn(set().union(*words))
        for own in words:
            yield iter((b"".join(map(self.known.__getitem__, own)),))

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids of a text, part by part."""
        if len(text) <= 4 * SLICE:
            yield self.ids(self.pattern.findall(text))
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while part := list(islice(found, 100_000)):
            yield self.ids(part)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _slot(key: int) -> int:
    full = (1 << 64) - 1
    key = ((key ^ (key >> 30)) * 0xBF58476D1CE4E5B9) & full
    key = ((key ^ (key >> 27)) * 0x94D049BB133111EB) & full
    return key ^ (key >> 31)


def _merge_many(pieces: list[bytes], width: int, vocabulary: Vocabulary) -> Iterator[bytes]:
    """Merges pieces of at most ``width`` bytes together, one segment tree a row."""
    rows, n = len(pieces), np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(rows, width)
    ids = vocabulary.single[data]
    place = np.arange(width)
    after = np.tile(place + 1, (rows, 1))  # the live neighbour on the right; width or more: none
    after[place[None, :] + 1 >= n[:, None]] = width
    before = np.tile(place - 1, (rows, 1))
    tree = np.full((rows, 2 * width), NONE, dtype=np.int64)
    r, c = np.nonzero(after < width)
    ranks = vocabulary.pair_ranks(ids[r, c], ids[r, c + 1])
    tree[r, width + c] = np.where(ranks == NONE, NONE, (ranks << POS) | c)
    for node in range(width - 1, 0, -1):
        np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
    live = place[None, :] < n[:, None]

    def write(row: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        node = at + width
        tree[row, node] = value
        for _ in range(width.bit_length() - 1):
            node = node >> 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

    row = np.arange(rows)
    while True:
        root = tree[row, 1]
        row = row[root != NONE]
        if not len(row):
            break
        root = root[root != NONE]
        at, rank = root & ((1 << POS) - 1), root >> POS
        eaten = after[row, at]
        beyond = after[row, eaten]
        ids[row, at] = rank
        live[row, eaten] = False
        after[row, at] = beyond
        write(row, eaten, np.full(len(row), NONE))
        some = beyond < width
        value = np.full(len(row), NONE)
        if some.any():
            rr, bb, aa = row[some], beyond[some], at[some]
            before[rr, bb] = aa
            ranks = vocabulary.pair_ranks(rank[some], ids[rr, bb])
            value[some] = np.where(ranks == NONE, NONE, (ranks << POS) | aa)
        write(row, at, value)
        left = before[row, at]
        some = left >= 0
        if some.any():
            rr, ll = row[some], left[some]
            ranks = vocabulary.pair_ranks(ids[rr, ll], rank[some])
            write(rr, ll, np.where(ranks == NONE, NONE, (ranks << POS) | ll))
    flat = ids[live].astype("<u4")
    ends = np.cumsum(live.sum(axis=1)) * 4
    packed, begin = flat.tobytes(), 0
    for end in ends.tolist():
        yield packed[begin:end]
        begin = end


def _merge_long(piece: bytes, vocabulary: Vocabulary) -> list[int]:
    """Merges one long piece with a tree of its own."""
    n = len(piece)
    ids = vocabulary.single[np.frombuffer(piece, dtype=np.uint8)].astype(np.int64)
    width = 1 << (n - 1).bit_length()
    tree = np.full(2 * width, NONE, dtype=np.int64)
    ranks = vocabulary.pair_ranks(ids[:-1], ids[1:])
    tree[width : width + n - 1] = np.where(ranks == NONE, NONE, (ranks << 32) | np.arange(n - 1))
    level = width
    while level > 1:
        tree[level // 2 : level] = np.minimum(tree[level : 2 * level : 2], tree[level + 1 : 2 * level : 2])
        level //= 2
    nodes, own, pairs = tree.tolist(), ids.tolist(), vocabulary.pairs
    after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)

    def write(at: int, value: int) -> None:
        node = at + width
        nodes[node] = value
        while node > 1:
            other = nodes[node ^ 1]
            value = other if other < value else value
            node >>= 1
            nodes[node] = value

    def value(at: int, to: int) -> int:
        rank = pairs.get((own[at], own[to]))
        return NONE if rank is None else rank << 32 | at

    while (root := nodes[1]) != NONE:
        at, rank = root & 0xFFFFFFFF, root >> 32
        eaten = after[at]
        beyond = after[eaten]
        own[at], gone[eaten], after[at] = rank, 1, beyond
        write(eaten, NONE)
        if beyond < n:
            before[beyond] = at
        write(at, value(at, beyond) if beyond < n else NONE)
        if before[at] >= 0:
            write(before[at], value(before[at], at))
    return [x for x, dead in zip(own, gone, strict=True) if not dead]


@cache
def vocabulary(path: str, pattern: str) -> Vocabulary:
    KEPT["bpe"] = vocabulary.cache_clear
    return Vocabulary(path, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _digests(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for part, texts in slices(batches, "text", SLICE, "bpe"):
            tokens, encoded, decoded = [], [], []
            for parts in v.encode_all(texts):
                a, b, n = hashlib.sha256(), hashlib.sha256(), 0
                for ids in parts:
                    a.update(ids)
                    b.update(v.decode(ids))
                    n += len(ids) // 4
                tokens.append(n)
                encoded.append(a.hexdigest())
                decoded.append(b.hexdigest())
            columns = (part.column("doc_id"), pa.array(tokens, pa.int64()), pa.array(encoded), pa.array(decoded))
            yield pa.record_batch(list(columns), names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        v.forget()

    return run


def encode_digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    a, b = (path, pattern) if path and pattern else default_vocabulary()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_digests(a, b), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every document."""
    a, b = (path, pattern) if path and pattern else default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(a, b)
        for part, texts in slices(batches, "text", SLICE, "bpe"):
            ids = [np.frombuffer(b"".join(parts), dtype="<u4").astype(np.int32) for parts in v.encode_all(texts)]
            yield pa.record_batch([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])
        v.forget()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and text of rows of ``encode``."""
    a, b = (path, pattern) if path and pattern else default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(a, b)
        for batch in batches:
            texts = [b"".join(v.bytes_of[i] for i in ids or ()).decode() for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(only(table(spark, sf_dir, "documents"), doc_id="long", text="string"))
