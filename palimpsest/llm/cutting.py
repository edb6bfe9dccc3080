"""Splitting oversized texts at natural boundaries by agglomerative merging.

A text is cut into atomic segments: sentences, lines, paragraphs and sections,
and runs of words where a segment alone is over the limit. Adjacent segments
are merged from a heap, the weakest boundary first, while the combined size plus
the overlap fits. What stays unmerged are the pieces.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

LIMIT = 400
OVERLAP = 40
#: Tokens are maximal runs of characters that are not ASCII white space.
TOKEN = re.compile(r"[^ \t\n\r\f\v]+")
#: Strengths of boundaries, weakest first.
WORD, SENTENCE, LINE, PARAGRAPH, SECTION = range(5)
NAMES = ("word", "sentence", "line", "paragraph", "section")
_SECTION = re.compile(r"#{1,6} |(?:export |public |private |static |async )*(?:def|class|func|function|struct|interface|impl)\b|=====|-----|diff --git ")


def _strength(gap: str, before: str, after: str) -> int:
    """The boundary between two tokens with `gap` between them."""
    breaks = gap.count("\n")
    if breaks:
        if _SECTION.match(after):
            return SECTION
        return PARAGRAPH if breaks > 1 else LINE
    if before[-1] in ".!?;:}" or (len(before) > 1 and before[-1] in "\"')`" and before[-2] in ".!?"):
        return SENTENCE
    return WORD


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int, str]]:
    """(start, body, end, tokens, boundary) of each piece.

    text[start:end] is a piece, text[body:end] the part that is not overlap; the
    bodies put together are the text. `boundary` is what the piece ends at.
    """
    spans = [m.span() for m in TOKEN.finditer(text)]
    n = len(spans)
    if n <= limit:
        return [(0, 0, len(text), n, "end")]
    fit = limit - overlap  # of a later piece, without its overlap
    if fit < 1:
        raise ValueError("the overlap leaves no room")
    # strength[i]: of the boundary before token i; a section's mark may stand deeper in its line.
    strength = [SECTION] * n
    for i in range(1, n):
        a, b = spans[i - 1][1], spans[i][0]
        strength[i] = _strength(text[a:b], text[spans[i - 1][0] : a], text[b : b + 48])
    starts = [0]
    for i in range(1, n):
        if strength[i] > WORD:
            starts.append(i)
    atoms: list[int] = []
    for j, s in enumerate(starts):  # an atom that doesn't fit is cut between words
        e = starts[j + 1] if j + 1 < len(starts) else n
        while e - s > fit:
            atoms.append(s)
            s += fit
        atoms.append(s)
    ends = {a: (atoms[j + 1] if j + 1 < len(atoms) else n) for j, a in enumerate(atoms)}
    left = {a: (atoms[j - 1] if j else -1) for j, a in enumerate(atoms)}
    heap = [(strength[a], ends[a] - left[a], a, left[a], ends[a]) for a in atoms[1:]]
    heapq.heapify(heap)
    alive = set(atoms)
    while heap:
        power, size, a, before, end = heapq.heappop(heap)
        if a not in alive or left[a] != before or ends[a] != end:
            continue  # one side has grown since
        if size > (limit if before == 0 else fit):
            continue
        alive.discard(a)
        ends[before] = end
        if end < n:
            left[end] = before
            heapq.heappush(heap, (strength[end], ends[end] - before, end, before, ends[end]))
        if before:
            heapq.heappush(heap, (strength[before], end - left[before], before, left[before], end))
    out, prior = [], 0
    cuts = sorted(alive)
    for j, a in enumerate(cuts):
        e = cuts[j + 1] if j + 1 < len(cuts) else n
        first = max(prior, a - overlap) if j else 0
        start, body = (spans[first][0], spans[a][0]) if j else (0, 0)
        stop = spans[e][0] if e < n else len(text)
        out.append((start, body, stop, e - first, NAMES[strength[e]] if e < n else "end"))
        prior = first
    return out


def split_oversized(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece of every text with more than `limit` tokens.

    Columns: key, piece_no from 0, piece, body_start (characters of `piece` that
    are overlap), n_tokens, boundary. Null, empty and blank texts and those within
    the limit give no rows; a null key gives none; repeated rows and rows that share
    key and text are one. Only oversized texts leave the JVM; one narrow stage
    after the rows are made distinct on key.
    """
    ship(df.sparkSession)
    big = df.select(F.col(key).alias(key), F.col(text).alias("__text")).where(F.col(key).isNotNull())
    big = big.where(F.length("__text") > 2 * limit).where(F.regexp_count("__text", F.lit(r"[^ \t\n\r\f\x0B]+")) > limit).dropDuplicates([key])
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, piece_no int, piece string, body_start int, n_tokens int, boundary string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, i, t[s:e], body - s, n, kind) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, (s, body, e, n, kind) in enumerate(pieces(t, limit, overlap))]
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.string())], [key, "piece_no", "piece", "body_start", "n_tokens", "boundary"])

    return big.mapInArrow(run, schema)
