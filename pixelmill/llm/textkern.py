"""Vectorised text kernels (numpy over UTF-8 buffers) shared by the Python-side operators.

Work is done on blocks of a few MB, cut between documents or, inside one very long
document, at white space, so memory does not grow with a text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 21  # bytes of text handled at once
_SEG = 1 << 20
_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE_FOLDED = _BYTE[_FOLD]
IS_SPACE = np.zeros(256, np.bool_)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = [np.uint64(int(x) | 1) for x in _rng.integers(1, 1 << 63, 16, dtype=np.uint64)]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], m, x = 1, 1, base
    while m < n:
        k = min(m, n - m)
        np.multiply(out[:k], np.uint64(x), out=out[m : m + k])
        m, x = m + k, x * x & _M64
    return out


_UP, _DOWN = np.empty(0, np.uint64), np.empty(0, np.uint64)


def _tables(n: int) -> None:
    global _UP, _DOWN
    if len(_UP) < n:
        n = max(n, _SEG + 1)
        _UP, _DOWN = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool) -> np.ndarray:
    """Hash of ``buf[s:e]`` for all spans of one segment, by prefix sums of a polynomial hash."""
    _tables(len(buf) + 1)
    value = (_BYTE_FOLDED if fold else _BYTE)[buf]
    value *= _UP[: len(buf)]
    total = np.empty(len(buf) + 1, np.uint64)
    total[0] = 0
    np.cumsum(value, out=total[1:])
    h = total[end]
    h -= total[start]
    h *= _DOWN[start]
    h += (end - start).astype(np.uint64)
    return mix(h)


def segments(buf: np.ndarray, size: int = _SEG) -> Iterator[tuple[int, int]]:
    """Cuts of ``buf`` after white space, about ``size`` bytes apart."""
    at = 0
    while at < len(buf):
        to = min(len(buf), at + size)
        while to < len(buf):
            back = np.flatnonzero(IS_SPACE[buf[at:to]])
            if len(back):
                to = at + int(back[-1]) + 1
                break
            to = min(len(buf), to + size)
        yield at, to
        at = to


def word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words ``[^\\x20\\x09-\\x0D]+`` of ``buf``, A-Z lower-cased."""
    starts, hashes = [], []
    for a, b in segments(buf):
        part = buf[a:b]
        gap = np.empty(len(part) + 2, np.bool_)
        gap[0] = gap[-1] = True
        np.take(IS_SPACE, part, out=gap[1:-1])
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        s, e = edge[0::2], edge[1::2]
        starts.append(s + a)
        hashes.append(span_hashes(part, s, e, True))
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def blocks(batch: pa.RecordBatch, text: str = "text", size: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of rows as ``(first row, texts as UTF-8)``, each of about ``size`` bytes; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(text))
    lengths = np.asarray(pc.fill_null(pc.binary_length(col), 0), np.int64)
    edge = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        done = int(edge[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(edge, done + size, "right")))
        part = pc.fill_null(col.slice(at, to - at), "").cast(pa.binary() if pa.types.is_string(col.type) else pa.large_binary())
        yield at, part.to_pylist()
        at = to


def doc_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and the bounds of each text in them (len + 1)."""
    buf = np.frombuffer(b" ".join(texts), np.uint8)
    at, h = word_hashes(buf)
    first = np.zeros(len(texts), np.int64)
    np.cumsum([len(t) + 1 for t in texts[:-1]], out=first[1:])
    bounds = np.append(np.searchsorted(at, first), len(h))
    return h, bounds


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``width``-word shingles.

    A text with fewer words has its whole sequence as one; one without words has none.
    """
    h, bounds = doc_words(texts)
    n = len(h)
    full = np.zeros(0, np.uint64)
    if n >= width:
        full = h[: n - width + 1] * _STEP[0]
        for k in range(1, width):
            full += h[k : n - width + 1 + k] * _STEP[k]
        full = mix(full)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= width:
            s = np.sort(full[a : b - width + 1])
            keep = np.empty(len(s), np.bool_)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for k in range(b - a):
                whole += h[a + k : a + k + 1] * _STEP[k]
            out.append(mix(whole + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
