"""Tokenising each distinct chunk of text once per worker.

Texts are cut at places where a tokenizer's own pattern always starts a new match (before
white space that follows a letter, digit or mark, and between letters, digits and
punctuation), so the ids of a text are the ids of its chunks in a row.  A bounded memo,
keyed by a 64-bit hash of the chunk, holds the ids the library gave for it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from pixelmill.llm.textkern import segments, span_hashes

_OTHER, _LETTER, _DIGIT, _MARK, _SPACE, _BREAK, _QUOTE = range(7)
_CLASS = np.zeros(256, np.uint8)
for _b in range(33, 127):
    _CLASS[_b] = _LETTER if chr(_b).isalpha() else _DIGIT if chr(_b).isdigit() else _MARK
_CLASS[39], _CLASS[32] = _QUOTE, _SPACE
_CLASS[9:14] = _BREAK
#: Pairs of classes between which no match of the patterns goes on.
_CUT = np.zeros(64, np.bool_)
for _a, _after in {
    _LETTER: (_SPACE, _BREAK, _MARK, _QUOTE, _DIGIT), _DIGIT: (_SPACE, _BREAK, _MARK, _QUOTE, _LETTER), _MARK: (_SPACE, _BREAK, _LETTER, _DIGIT),
    _QUOTE: (_SPACE, _BREAK), _BREAK: (_LETTER, _DIGIT, _MARK, _QUOTE),
}.items():
    _CUT[[8 * _a + b for b in _after]] = True


def chunk_starts(buf: np.ndarray) -> np.ndarray:
    """Positions other than 0 at which ``buf`` may be cut."""
    kind = _CLASS[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3)  # U+00C0 to U+00FF: letters but for two signs
    if len(lead):
        after = buf[lead + 1]
        lead = lead[(after != 0x97) & (after != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
    return np.flatnonzero(_CUT[(kind[:-1] << 3) | kind[1:]]) + 1


class ChunkMemo:
    """Ids of chunks, by the chunk's hash; forgets everything when ``limit`` chunks are exceeded."""

    def __init__(self, encode: Callable[[list[str]], list], fold: bool, limit: int = 600_000):
        self.encode, self.fold, self.limit = encode, fold, limit
        self._clear()

    def _clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.at, self.count = np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat = np.empty(0, np.uint32)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        ids = self.encode(texts)
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        at = len(self.flat) + np.cumsum(count) - count
        self.flat = np.concatenate([self.flat, np.fromiter((x for e in ids for x in e), np.uint32, int(count.sum()))])
        where = np.searchsorted(self.keys, keys)
        self.at, self.count = np.insert(self.at, where, at), np.insert(self.count, where, count)
        self.keys = np.insert(self.keys, where, keys)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the bounds of each text in them (len + 1)."""
        raw = b"".join(texts)
        buf = np.frombuffer(raw, np.uint8)
        edge = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=edge[1:])
        if not len(buf):
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        begins = np.zeros(len(buf), np.bool_)
        begins[chunk_starts(buf)] = True
        begins[edge[:-1][edge[:-1] < edge[1:]]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(buf))
        h = np.empty(len(start), np.uint64)
        cuts = [0]
        for _, b in segments(buf):  # a chunk may go over a segment's end, so segments end where a chunk does
            cuts.append(int(end[min(len(end) - 1, np.searchsorted(end, b))]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a < b:
                i, k = np.searchsorted(start, (a, b))
                h[i:k] = span_hashes(buf[a:b], start[i:k] - a, end[i:k] - a, self.fold)
        found, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) + len(found) > self.limit:
            self._clear()
        where = np.searchsorted(self.keys, found)
        new = np.ones(len(found), np.bool_)
        inside = where < len(self.keys)
        new[inside] = self.keys[where[inside]] != found[inside]
        if new.any():
            s, e = start[first[new]].tolist(), end[first[new]].tolist()
            self._learn(found[new], [raw[a:b].decode("utf-8", "replace") for a, b in zip(s, e)])
            where = np.searchsorted(self.keys, found)
        which = where[back]
        count = self.count[which]
        to = np.cumsum(count)
        ids = self.flat[np.repeat(self.at[which] - (to - count), count) + np.arange(int(to[-1]))]
        bounds = np.append(0, to)[np.searchsorted(start, edge)]
        return ids, bounds
