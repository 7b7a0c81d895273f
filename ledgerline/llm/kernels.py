"""Vectorised kernels shared by the operators: slices of Arrow batches, word and shingle hashes, sorted sets.

Hashes are 64 bits wide and the same in every process. Words are what lies between the ASCII white space characters
(0x20 and 0x09 to 0x0D) once A-Z are lower-cased, which is what ``bytes.lower`` and ``bytes.split`` do.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE = 1 << 20
_M1, _M2, _GOLD = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * _M1
        x = (x ^ (x >> U(27))) * _M2
        return x ^ (x >> U(31))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def raw(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def release() -> None:
    """Gives back what a task has freed: workers serve many tasks, and what they keep adds up on an executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: What operators keep in a worker between their tasks, by name, and how it is dropped once tasks of others come.
KEPT: dict[str, Callable[[], None]] = {}


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE, keeps: str = "") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows whose texts come to about ``limit`` bytes, or one longer text alone: what bounds memory. What operators other than ``keeps`` have left in this worker goes."""
    for name in [n for n in KEPT if n != keeps]:
        KEPT.pop(name)()
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        begin = size = 0
        held: list[bytes] = []
        for i in range(batch.num_rows):
            value = column[i].as_buffer() if column[i].is_valid else None
            data = value.to_pybytes() if value is not None else b""
            if held and size + len(data) > limit:
                yield batch.slice(begin, i - begin), held
                begin, size, held = i, 0, []
            held.append(data)
            size += len(data)
        if held:
            yield batch.slice(begin), held
    release()


@cache
def _letters() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * _GOLD) | U(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    p = 0x5851F42D4C957F2D
    inverse = pow(p, -1, 1 << 64)
    out = []
    for base in (p, inverse):
        steps = np.full(n, base, dtype=U)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


#: Bytes of nearly all buffers: one table of powers serves them, which grows by steps to what they need.
_USUAL, _STEP = 1 << 21, 1 << 17
_held = _powers(1)


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _held
    if n > _USUAL:
        return _powers(n)
    if len(_held[0]) < n:
        _held = _powers(-(-n // _STEP) * _STEP)
    return _held


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans of bytes, wherever they lie: a polynomial of the bytes, shifted back by the place, with the length."""
    up, down = _table(len(buf))
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, dtype=U), np.cumsum(_letters()[buf] * up[: len(buf)], dtype=U)))
        return mix(((total[end] - total[start]) * down[start]) ^ ((end - start).astype(U) * _GOLD))


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of bytes that aren't ASCII white space begin and end."""
    word = ~SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    return edge[0::2], edge[1::2]


def _words(data: bytes, head: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and hashes of the words of lower-cased bytes, or of the words' first ``head`` bytes."""
    buf = np.frombuffer(data, dtype=np.uint8)
    start, end = word_spans(buf)
    if head:
        end = np.minimum(end, start + head)
    if not len(start):
        return start, np.zeros(0, dtype=U)
    return start, span_hashes(buf, start, end)


def word_hashes(docs: list[bytes], head: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the offsets at which each text's words begin (one more than texts)."""
    lowered = [d.lower() for d in docs]
    if len(docs) == 1 and len(lowered[0]) > 4 * SLICE:  # a very long text: piece by piece, cut at white space
        data, parts, at = lowered[0], [], 0
        while at < len(data):
            to = min(len(data), at + SLICE)
            while to < len(data) and not SPACE[data[to]]:
                to += 1
            parts.append(_words(data[at:to], head)[1])
            at = to
        joined = np.concatenate(parts)
        return joined, np.array([0, len(joined)])
    lengths = np.fromiter(map(len, lowered), dtype=np.int64, count=len(docs))
    begins = np.concatenate(([0], np.cumsum(lengths + 1)))
    start, hashes = _words(b" ".join(lowered), head)
    return hashes, np.searchsorted(start, begins)


def shingle_sets(docs: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of ``width``-word shingles.

    A text with fewer words has one shingle, its whole sequence; one without words has none.
    """
    words, at = word_hashes(docs)
    n = len(words)
    rolled = np.zeros(max(0, n - width + 1), dtype=U)
    with np.errstate(over="ignore"):
        for j in range(width):
            factor = U(int(mix(np.array([j + 77], dtype=U))[0]) | 1)
            rolled += words[j : j + len(rolled)] * factor
        rolled = mix(rolled)
        out = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= width:
                own = np.sort(rolled[a : b - width + 1])
                keep = np.ones(len(own), dtype=bool)
                keep[1:] = own[1:] != own[:-1]
                out.append(own[keep])
            elif b > a:
                weights = mix(np.arange(1, b - a + 1, dtype=U) * _GOLD) | U(1)
                out.append(mix(np.array([(words[a:b] * weights).sum(dtype=U) ^ U(b - a)], dtype=U)))
            else:
                out.append(np.zeros(0, dtype=U))
    return out


def set_print(values: np.ndarray) -> tuple[int, int]:
    """Two 64-bit fingerprints of a sorted set."""
    with np.errstate(over="ignore"):
        a = mix(np.atleast_1d(mix(values ^ _GOLD).sum(dtype=U) ^ U(len(values))))[0]
        b = mix(np.atleast_1d((mix(values + _M1) * _M2).sum(dtype=U) + U(len(values))))[0]
    return int(a.view(np.int64)), int(b.view(np.int64))


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


class Forest:
    """Union-find over 0..n-1; the smaller root wins."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes that the edges (a, b) name, and for each the least node of its component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):  # every label is a root here; of two roots that an edge joins the larger hangs on the smaller
        p, q = label[x], label[y]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    return nodes, nodes[label]
