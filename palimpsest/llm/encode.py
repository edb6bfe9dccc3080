"""Encoding a corpus with a public tokenizer by monoid tree reduction.

A text is halved recursively down to leaves; neighbours are joined by
re-encoding a window around their seam. Pre-tokens are matched from left to
right and a match looks only ahead, so

* the pre-tokens of the left part that end well before its end stay as they are;
* once a pre-token boundary of the re-encoded window falls on a boundary of the
  right part, everything after it stays as it is.

The window grows until both hold, so tokens outside are provably final. Nodes
hold their pre-token starts and ids, which makes joining associative.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import ship
from .vocab import BYTE_BPE, DEFAULT_DIR, encoder, splitter

#: Characters of a leaf; longer texts are encoded as a tree.
LEAF_CHARS = 8192
#: Pre-tokens kept out of a left part at first; doubled until the seam is stable.
SEAM = 4


@dataclass
class Node:
    """A part of a text: its span, the starts of its pre-tokens and the ids of each."""

    start: int
    end: int
    starts: list[int] = field(default_factory=list)
    ids: list[list[int]] = field(default_factory=list)


#: The ids of pre-tokens met before in this worker, by encoding; forgotten when they are too many.
_KNOWN: dict[int, dict[str, list[int]]] = {}
KNOWN = 200_000


def _leaf(text: str, start: int, end: int, enc, pat) -> Node:
    node = Node(start, end)
    known = _KNOWN.setdefault(id(enc), {})
    for m in pat.finditer(text[start:end]):
        piece = m.group()
        ids = known.get(piece)
        if ids is None:
            if len(known) >= KNOWN:
                known.clear()
            ids = known[piece] = enc.encode_ordinary(piece)
        node.starts.append(start + m.start())
        node.ids.append(ids)
    return node


def join(text: str, left: Node, right: Node, enc, pat) -> Node:
    """The node of both parts' span; re-encodes only around the seam."""
    if not left.starts:
        return Node(left.start, right.end, right.starts, right.ids)
    if not right.starts:
        return Node(left.start, right.end, left.starts, left.ids)
    back, ahead = SEAM, SEAM
    while True:
        keep = max(0, len(left.starts) - back)
        # White space is matched with a look ahead, so a kept pre-token must be followed by text of its own part.
        if keep and not text[left.starts[keep] : left.end].strip():
            back *= 2
            continue
        begin = left.starts[keep]
        stop = min(ahead, len(right.starts))
        end = right.starts[stop] if stop < len(right.starts) else right.end
        window = _leaf(text, begin, end, enc, pat)
        if end == right.end:
            return Node(left.start, right.end, left.starts[:keep] + window.starts, left.ids[:keep] + window.ids)
        for i, s in enumerate(window.starts):
            # The last matches of the window may still change with what follows.
            if s < right.start or i + SEAM > len(window.starts) or not text[s:end].strip():
                continue
            j = bisect.bisect_left(right.starts, s)
            if j < len(right.starts) and right.starts[j] == s:
                return Node(left.start, right.end, left.starts[:keep] + window.starts[:i] + right.starts[j:], left.ids[:keep] + window.ids[:i] + right.ids[j:])
        ahead *= 2


def tree(text: str, enc, pat, start: int = 0, end: int | None = None, leaf: int = LEAF_CHARS) -> Node:
    """The node of text[start:end], by halves."""
    end = len(text) if end is None else end
    if end - start <= leaf:
        return _leaf(text, start, end, enc, pat)
    mid = (start + end) // 2
    return join(text, tree(text, enc, pat, start, mid, leaf), tree(text, enc, pat, mid, end, leaf), enc, pat)


def encode(text: str | None, enc, pat, leaf: int = LEAF_CHARS) -> list[int]:
    """Ids of a whole text; the empty list for null and empty ones."""
    if not text:
        return []
    if len(text) <= leaf:
        return enc.encode_ordinary(text)
    return [i for ids in tree(text, enc, pat, leaf=leaf).ids for i in ids]


def decode(ids, enc, leaf: int = 1024) -> bytes:
    """The bytes of the ids, concatenated up a tree of the same shape."""
    ids = list(ids)
    if len(ids) <= leaf:
        return enc.decode_bytes(ids)
    mid = len(ids) // 2
    return decode(ids[:mid], enc, leaf) + decode(ids[mid:], enc, leaf)


def encode_texts(df: DataFrame, key: str, text: str, name: str = BYTE_BPE, folder: str = DEFAULT_DIR, leaf: int = LEAF_CHARS) -> DataFrame:
    """(key, ids) of every row of `df`; one narrow stage, no shuffle.

    Null and empty texts give the empty list; a null key stays null; repeated
    rows give repeated rows; other columns are not read.
    """
    ship(df.sparkSession)
    schema = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pat = encoder(name, folder), splitter(name, folder)
        for b in batches:
            ids = [encode(x, enc, pat, leaf) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    return df.select(key, text).mapInArrow(run, schema)


def count_tokens(df: DataFrame, key: str, text: str, name: str = BYTE_BPE, folder: str = DEFAULT_DIR) -> DataFrame:
    """(key, size) with the number of ids of every non-empty text."""
    ship(df.sparkSession)
    schema = T.StructType([df.schema[key], T.StructField("size", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pat = encoder(name, folder), splitter(name, folder)
        for b in batches:
            sizes = [len(encode(x, enc, pat)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], [key, "size"])

    return df.select(key, text).where(f"length(`{text}`) > 0").mapInArrow(run, schema)
