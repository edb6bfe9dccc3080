"""Full-text search: query parsing, postings, boolean and phrase matching, BM25."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ACCENTED, PLAIN, tokens
from ..session import ship

K1, B = 1.2, 0.75
#: What the inverse document frequency becomes where it isn't positive.
LEAST_IDF = 1e-6
MAX_TERMS, TERM_CHARS, PHRASE_CHARS = 50, 128, 256
_OPERATORS = ("AND", "OR", "NOT", "NEAR")


@dataclass(frozen=True)
class Term:
    """A phrase, and the operator that joins it to what stands before."""

    text: str
    op: str = "AND"

    def words(self) -> list[str]:
        folded = self.text.lower().translate(str.maketrans(ACCENTED, PLAIN))
        return [t for t in re.split(r"[\W_]+", folded) if t]


def parse(query: str, mode: str = "strict") -> list[Term]:
    """The terms of a query: all of them (strict), any of them, or one phrase.

    In strict mode the words and, or, not and near join the next term; elsewhere, and before any term, they are dropped.
    More than 50 terms are an error.
    """
    if mode not in ("strict", "any", "phrase"):
        raise ValueError(f"unknown mode {mode!r}")
    clean = lambda s, n: " ".join(re.sub(r"[*^(){}<>]", " ", s).split())[:n]
    if mode == "phrase":
        phrase = clean(query.replace('"', " "), PHRASE_CHARS)
        return [Term(phrase)] if phrase else []
    out: list[Term] = []
    op = None
    for raw in re.findall(r'"[^"]*"|[()]|[^\s()]\S*', query):
        if raw in "()":
            continue
        quoted = raw.startswith('"') and raw.endswith('"') and len(raw) > 1
        if not quoted and raw.upper() in _OPERATORS:
            op = raw.upper() if mode == "strict" and out else None
            continue
        text = clean(raw[1:-1], PHRASE_CHARS) if quoted else clean(raw, TERM_CHARS)
        if text:
            out.append(Term(text, op or ("OR" if mode == "any" else "AND")))
            op = None
    if len(out) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    return out


def render(terms: list[Term]) -> str:
    """The terms as a match expression."""
    return "".join((f" {t.op} " if i else "") + f'"{t.text}"' for i, t in enumerate(terms))


def tree(terms: list[Term]) -> tuple | None:
    """Nested (op, left, right), with NOT binding tighter than AND and AND tighter than OR.

    A term without a letter or digit matches nothing: with AND the whole is empty, with OR it is left out. "a NEAR b" is
    read as both of them and the word near.
    """
    flat: list[tuple[str, tuple]] = []
    for i, t in enumerate(terms):
        op = t.op if i else "OR"
        if op == "NEAR":
            flat.append(("AND", ("phrase", ("near",))))
            op = "AND"
        flat.append((op, ("phrase", tuple(t.words()))))
    groups: list[list] = []
    for op, leaf in flat:
        if op == "OR":
            groups.append([leaf])
        elif op == "AND":
            groups[-1].append(leaf)
        else:
            groups[-1][-1] = ("NOT", groups[-1][-1], leaf)
    alive = [reduce(lambda a, b: ("AND", a, b), g) for g in groups if not any(leaf == ("phrase", ()) for leaf in g)]
    return reduce(lambda a, b: ("OR", a, b), alive) if alive else None


def phrases(node: tuple | None, positive: bool = True) -> list[tuple[str, ...]]:
    """The phrases that count for the score, in order and once each."""
    if node is None:
        return []
    if node[0] == "phrase":
        return [node[1]] if positive else []
    both = phrases(node[1], positive) + phrases(node[2], positive and node[0] != "NOT")
    return list(dict.fromkeys(both))


def padded(toks: Column) -> Column:
    """Tokens as one string in which each stands between blanks of its own."""
    return F.concat(F.lit(" "), F.array_join(toks, "  "), F.lit(" "))


def _needle(words: tuple[str, ...]) -> str:
    return " " + "  ".join(words) + " "


def condition(node: tuple | None, text: Column) -> Column:
    if node is None:
        return F.lit(False)
    if node[0] == "phrase":
        return text.contains(_needle(node[1]))
    a, b = condition(node[1], text), condition(node[2], text)
    return a & b if node[0] == "AND" else a | b if node[0] == "OR" else a & ~b


def postings(df: DataFrame, key: str, text: str, also: list[str] | None = None) -> DataFrame:
    """(*also, key, term, tf, dl, positions): an inverted index, positions from 0 in order. One narrow stage, no shuffle.

    Null and empty texts have no postings. Rows that share a key are indexed each.
    """
    ship(df.sparkSession)
    cols = [*(also or []), key]
    toks = df.select(*cols, tokens(F.col(text)).alias("__toks")).where(F.size("__toks") > 0)
    n = len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                lists = part.column(n)
                lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                words = lists.flatten().dictionary_encode()
                code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(len(lengths)), lengths)
                pos = np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                order = np.argsort(doc * (len(words.dictionary) + 1) + code, kind="stable")  # positions stay in order
                d, c = doc[order], code[order]
                first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (c[1:] != c[:-1])]))
                ends = np.append(first, len(d))
                owner = pa.array(d[first])
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i).take(owner) for i in range(n)], words.dictionary.take(pa.array(c[first])), pa.array(np.diff(ends)), pa.array(lengths[d[first]]), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(pos[order].astype(np.int32)))],
                    [*cols, "term", "tf", "dl", "positions"],
                )

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)
    return toks.mapInArrow(run, f"{kinds}, term string, tf long, dl long, positions array<int>")


def totals(df: DataFrame, text: str, group: list[str] | None = None) -> DataFrame:
    """(*group, docs, tokens): how many texts there are, null and empty ones too, and their tokens."""
    size = F.size(tokens(F.coalesce(F.col(text), F.lit(""))))
    return df.groupBy(*(group or [])).agg(F.count("*").alias("docs"), F.coalesce(F.sum(size), F.lit(0)).alias("tokens"))


def every_phrase(node: tuple | None) -> list[tuple[str, ...]]:
    """All phrases of a tree, in order and once each."""
    if node is None:
        return []
    found = [node[1]] if node[0] == "phrase" else every_phrase(node[1]) + every_phrase(node[2])
    return list(dict.fromkeys(found))


def match(index: DataFrame, sums: DataFrame, key: str, terms: list[Term], also: list[str] | None = None, within: Column | None = None) -> DataFrame:
    """(key, *also, score) of every row of a stored index that matches; lower is better.

    `index` are postings, of which only those of the query's words are read, and `sums` rows of totals. The statistics
    are those of the whole index; `within`, a condition on `also`, restricts what comes out. A phrase occurs wherever its
    words stand in a row. A query without terms matches nothing.
    """
    node, also = tree(terms), also or []
    every, scored = every_phrase(node), phrases(node)
    if not every:
        return index.select(key, *also, F.lit(0.0).alias("score")).limit(0)
    words = sorted({w for p in every for w in p})
    hit = index.where(F.col("term").isin(words))
    spread = sorted({w for p in every if len(p) > 1 for w in p})
    wanted = {w: F.max(F.when(F.col("term") == w, F.col("tf"))).alias(f"tf_{i}") for i, w in enumerate(words)}
    places = {w: F.max(F.when(F.col("term") == w, F.col("positions"))).alias(f"at_{i}") for i, w in enumerate(words) if w in spread}
    docs = hit.groupBy(key, *also).agg(F.max("dl").alias("dl"), *wanted.values(), *places.values())
    number = {w: i for i, w in enumerate(words)}

    def freq(p: tuple[str, ...]) -> Column:
        if len(p) == 1:
            return F.coalesce(F.col(f"tf_{number[p[0]]}"), F.lit(0))
        rest = [F.col(f"at_{number[w]}") for w in p[1:]]
        runs = F.filter(F.col(f"at_{number[p[0]]}"), lambda x: reduce(lambda a, b: a & b, [F.array_contains(r, x + i) for i, r in enumerate(rest, 1)]))
        return F.coalesce(F.size(runs), F.lit(0))

    rows = docs.select(key, *also, "dl", *[F.greatest(freq(p), F.lit(0)).alias(f"f{i}") for i, p in enumerate(every)])
    held = rows.agg(*[F.count(F.when(F.col(f"f{i}") > 0, 1)).alias(f"n{i}") for i in range(len(every))])
    corpus = sums.agg(F.sum("docs").alias("total"), (F.sum("tokens") / F.sum("docs")).alias("avgdl"))

    def holds(x: tuple) -> Column:
        if x[0] == "phrase":
            return F.col(f"f{every.index(x[1])}") > 0
        a, b = holds(x[1]), holds(x[2])
        return a & b if x[0] == "AND" else a | b if x[0] == "OR" else a & ~b

    found = rows.where(holds(node))
    found = found.where(within) if within is not None else found
    both = found.crossJoin(F.broadcast(held)).crossJoin(F.broadcast(corpus))  # one row each
    score = F.lit(0.0)
    for p in scored:
        i = every.index(p)
        t = F.col(f"f{i}")
        score = score - idf(F.col(f"n{i}"), F.col("total")) * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return both.select(key, *also, F.round(score, 6).alias("score"))


def best(index: DataFrame, sums: DataFrame, key: str, query: str, limit: int = 200, mode: str = "strict", also: list[str] | None = None, within: Column | None = None) -> DataFrame:
    """(key, score): the best `limit` rows of a query on a stored index, ties by key."""
    return match(index, sums, key, parse(query, mode), also, within).orderBy("score", key).limit(limit).select(key, "score")


def idf(n: Column, total: Column) -> Column:
    value = F.log((total - n + 0.5) / (n + 0.5))
    return F.when(value <= 0, LEAST_IDF).otherwise(value)


def bm25(df: DataFrame, key: str, text: str, terms: list[Term], also: list[str] | None = None) -> DataFrame:
    """(key, *also, score) of every row that matches, of texts without a stored index; lower is better.

    One pass finds frequencies and lengths of the whole corpus, a second scores: neither shuffles rows, only one row of
    sums per task. Null texts count as empty documents. A query without terms matches nothing.
    """
    node = tree(terms)
    also = also or []
    scored = phrases(node)
    base = df.select(F.col(key), *also, tokens(F.coalesce(F.col(text), F.lit(""))).alias("toks"))
    base = base.select(key, *also, F.size("toks").alias("dl"), padded(F.col("toks")).alias("body"))
    tf = [((F.length("body") - F.length(F.replace("body", F.lit(_needle(p)), F.lit("")))) / len(_needle(p))).alias(f"tf{i}") for i, p in enumerate(scored)]
    rows = base.select("*", *tf)
    sums = rows.agg(F.count("*").alias("total"), F.avg("dl").alias("avgdl"), *[F.sum(F.when(F.col(f"tf{i}") > 0, 1).otherwise(0)).alias(f"n{i}") for i in range(len(scored))])
    # One row of sums, joined to every document.
    both = rows.where(condition(node, F.col("body"))).crossJoin(F.broadcast(sums))
    score = F.lit(0.0)
    for i in range(len(scored)):
        t = F.col(f"tf{i}")
        score = score - idf(F.col(f"n{i}"), F.col("total")) * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return both.select(key, *also, F.round(score, 6).alias("score"))


def search(df: DataFrame, key: str, text: str, query: str, limit: int = 200, mode: str = "strict") -> DataFrame:
    """The best `limit` rows of a query, ties by key."""
    return bm25(df, key, text, parse(query, mode)).orderBy("score", key).limit(limit)
