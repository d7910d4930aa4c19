"""Whole-batch text kernels on Arrow buffers: lower-cased words as 64-bit hashes, and n-grams of them.

A word is a maximal run of ASCII letters, digits and bytes from 0x80; everything else separates.
"""

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 512 << 10  # bytes of text handled at once; a longer text is a piece of its own
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def tables() -> dict:
    """Byte codes and the table of word bytes; made once for each task."""
    word = np.zeros(256, bool)
    word[128:] = True
    for a, b in ((48, 58), (65, 91), (97, 123)):
        word[a:b] = True
    return {"code": mix(np.arange(1, 257, dtype=_U) * _STEP), "word": word, "pow": np.ones(1, _U), "back": np.ones(1, _U)}


def _powers(t: dict, n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(t["pow"]) < n:
        for k, base in (("pow", _STEP), ("back", _BACK)):
            p = np.full(max(n, PIECE), base, _U)
            p[0] = 1
            t[k] = np.cumprod(p)
    return t["pow"][:n], t["back"]


def pieces(texts: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about `limit` bytes together."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    total, lo = np.cumsum(size), 0
    while lo < len(size):
        done = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + limit, side="right")))
        yield lo, hi
        lo = hi


def raw(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, each text followed by a space, and the texts' offsets."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    texts = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(texts) == 0 or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]


def spans(b: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; b ends with a space."""
    m = t["word"][b].view(np.int8)
    edge = np.flatnonzero(np.diff(m, prepend=np.int8(0)))
    return edge[0::2], edge[1::2]


def words(texts: pa.Array, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin (one more entry than texts)."""
    b, off = raw(texts)
    s, e = spans(b, t)
    p, back = _powers(t, len(b))
    total = np.zeros(len(b) + 1, _U)
    np.cumsum(t["code"][b] * p, out=total[1:])
    return mix((total[e] - total[s]) * back[s]), np.searchsorted(s, off)


def ngrams(h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word sequences of each text and where each text's begin. A text of fewer words has one, of all its words."""
    count = np.diff(at)
    k = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    starts = np.concatenate([[0], np.cumsum(k)])
    first = np.repeat(at[:-1] - starts[:-1], k) + np.arange(starts[-1])
    left = np.repeat(at[1:], k) - first
    g = np.zeros(len(first), _U)
    for j in range(n):
        w = h[np.minimum(first + j, max(len(h) - 1, 0))] if len(h) else g
        g = g * _STEP + np.where(j < left, w, _U(0))
    return mix(g), starts


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a Python worker, which later tasks use again, gives its free memory back to the system."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return whole
