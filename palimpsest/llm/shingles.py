"""Word shingles of Arrow string columns, hashed in numpy without a Python loop over rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.default_rng(20_240_607)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Shingles:
    """The distinct shingles of a batch's texts, ordered by text and hash.

    `doc` are positions in the batch; texts with too few tokens are not in `docs`.
    """

    docs: np.ndarray  # positions of the texts that have shingles
    doc: np.ndarray  # for each shingle, an index into docs
    hash: np.ndarray
    size: np.ndarray  # distinct shingles of each of docs

    def cls(self) -> np.ndarray:
        """A 64-bit id of each text's set of shingles, as signed integers."""
        starts = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64)
        total = np.add.reduceat(mix(self.hash ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
        return mix(total + self.size.astype(np.uint64)).view(np.int64)


def _bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The data and the offsets of a string column; nulls are empty."""
    col = col.fill_null("") if col.null_count else col
    wide = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def shingles(col: pa.Array, width: int, min_tokens: int) -> Shingles:
    """The sets of `width` consecutive tokens of the texts with at least `min_tokens` tokens.

    Tokens are maximal runs of characters other than ASCII white space, compared byte by byte.
    """
    data, offsets = _bytes(col)
    base, end = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    data, offsets = data[base:end], offsets - base
    none = Shingles(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if not len(data):
        return none
    solid = ~_SPACE[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begin[edges] = solid[edges]  # a text's first character never continues the text before
    starts = np.flatnonzero(begin)
    if not len(starts):
        return none
    owner = np.searchsorted(offsets, starts, "right") - 1
    reach = np.append(starts[1:], len(data)) - starts
    at = np.arange(len(data), dtype=np.int64)
    at[starts[0] :] -= np.repeat(starts, reach)
    powers = np.cumprod(np.full(int(reach.max()) + 1, _BASE))
    value = _BYTE[data] * powers[np.minimum(at, len(powers) - 1)]
    value[~solid] = 0
    token = mix(np.add.reduceat(value, starts))
    counts = np.bincount(owner, minlength=len(col))
    ok = counts >= max(min_tokens, width)
    n = len(token) - width + 1
    if n < 1:
        return none
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + token[i : n + i])
    keep = (owner[:n] == owner[width - 1 :]) & ok[owner[:n]]
    h, who = h[keep], owner[:n][keep]
    if not len(h):
        return none
    order = np.lexsort((h, who))
    h, who = h[order], who[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    h, who = h[new], who[new]
    docs, doc, size = np.unique(who, return_inverse=True, return_counts=True)
    return Shingles(docs, doc, h, size)
