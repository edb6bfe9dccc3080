"""Languages of documents and of their paragraphs by error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over
hashed character n-grams predicts, for a sentence, on which side it stands;
decoding sums each codeword's losses, weighted by how far the bit's classifier can be
trusted, and takes the nearest. A small gap to the second nearest is flagged as
ambiguous. Sentences vote with their letters for their paragraph, paragraphs
for their document.

The classifiers are fitted on a sample of labelled documents, bounded per
language; sentences whose label a fit contradicts are left out of the next, as labels
may be wrong. Everything else covers all rows and whole texts.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Labelled documents per language that the classifiers are fitted on, at most, sentences of each, and characters of these.
SAMPLE_DOCS, SAMPLE_SENTENCES, SENTENCE_CHARS = 150, 12, 400
FEATURES, BITS = 2048, 16
#: Bytes of the sums of all languages up to which they are kept between the fits.
GRAM_BYTES = 320 << 20
#: Letters that a paragraph's prose has at least, and where a letter is a word or a syllable.
LETTERS, LETTERS_WIDE = 8, 4
#: Gap of losses, as a part of the larger, below which a sentence is ambiguous.
AMBIGUOUS = 0.04

_FENCE = re.compile(r"\s*(?:```|~~~)")
_SKIP = re.compile(r"\s*(?:#|Traceback \(|File \"|at [\w.$<>]+[ (]|[\w.]*(?:Error|Exception)\b:?|\|.*\|\s*$|[\w.\-]+\s*[:=]?\s*[\d.,]*\s*$)")
_SENTENCE_END = re.compile(r"[a-z]{3}[.!?]$")
_REPEATED = re.compile(r"(\S{1,8}?)\1{7,}")
_LONG = re.compile(r"\S{24}")
_TICKS = re.compile(r"`[^`\n]*`")
_ODD = re.compile(r"[_0-9<\[]|[a-z][A-Z]|\(\)|://")
_CODE = re.compile(r"https?://\S+|<[^<>\s]{1,24}>|\[[A-Z]{2,9}\]|(?<![A-Za-z0-9_.\-/\\])[A-Za-z.\-/\\]*[_0-9][A-Za-z0-9_.\-/\\]*(?:\(\))?|(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9]*\(\)|(?<![A-Za-z0-9])[a-z]+[A-Z]\w*")
_WRONG = re.compile("[\u00c2-\u00f4][\u0080-\u00bf\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u203a\u20ac\u2122]")
_HIDDEN = re.compile("[\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]|\u001b\\[[0-9;]*m")
_STOP = re.compile("[.!?…]+(?=\\s|$)|[。！？:：()«»\"“”„\n\u2022→]")
_WIDE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")


class _Letters(dict):
    """Characters as they count: letters in lower case, marks and apostrophes; all others are blanks."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = c.lower() if c.isalpha() else c if c in "'’\n" or unicodedata.category(c) == "Mn" else " "
        return out


_LETTERS = _Letters()


def _byte(c: str) -> bytes:
    try:
        return c.encode("cp1252")
    except UnicodeEncodeError:
        return c.encode("latin-1")


def repair(text: str) -> str:
    """UTF-8 that was read as a single-byte encoding, read again; other text as it is."""
    if not _WRONG.search(text):
        return text
    try:
        return b"".join(_byte(c) for c in text).decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        # Line by line or word by word, where only a part was misread.
        def part(m: re.Match) -> str:
            try:
                return b"".join(_byte(c) for c in m.group()).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                return m.group()

        return re.sub(r"[^\s]*[\u00c2-\u00f4][^\s]*", part, text)


def paragraphs(text: str) -> Iterator[tuple[int, str]]:
    """(number from 1, lines outside fenced code) of each maximal run of lines that aren't blank."""
    no, held, fenced, inside = 0, [], False, False
    for line in text.split("\n"):
        if not line.strip():
            if inside:
                yield no, "\n".join(held)
            held, inside = [], False
            continue
        if not inside:
            no, inside = no + 1, True
        if _FENCE.match(line):
            fenced = not fenced
        elif not fenced:
            held.append(line)
    if inside:
        yield no, "\n".join(held)


def _skipped(line: str) -> bool:
    """A line that is no prose: a heading, a part of a trace, a table, a name with a value."""
    m = _SKIP.match(line)
    if not m:
        return False
    return bool(_SKIP.fullmatch(line)) or line.lstrip()[:1] in "#TFa|" and m.end() > 3 and not _SENTENCE_END.search(line)


def sentences(para: str) -> list[str]:
    """The prose of a paragraph in parts, lower case, words parted by one blank; empty where there is none."""
    if not para.replace("\n", "").isprintable():
        para = _HIDDEN.sub("", para)
    text = unicodedata.normalize("NFC", repair("\n".join([x for x in para.split("\n") if not _skipped(x)])))
    if _LONG.search(text):
        text = _REPEATED.sub(" ", text)
    if "`" in text:
        text = _TICKS.sub(" ", text)
    if _ODD.search(text):
        text = _CODE.sub(" ", text)
    text = _STOP.sub("\n", text).translate(_LETTERS)
    out = [s for s in [" ".join(x.split()) for x in text.split("\n")] if s]
    whole = " ".join(out)
    wide = not whole.isascii() and bool(_WIDE.search(whole))
    words = whole.count(" ") + 1
    letters = len(whole) - words + 1
    if letters < (LETTERS_WIDE if wide else LETTERS) or not wide and words < 2:
        return []
    return out


_SALT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint64)


def features(parts: list[str]) -> np.ndarray:
    """Counts of hashed character 1- to 4-grams, words marked at both sides, over the root of their number; a row per part."""
    joined = "\x00".join(f" {s} " for s in parts)
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    part = np.cumsum(code == 0) * FEATURES
    h = np.zeros(len(code), np.uint64)
    live = code != 0
    cells = []
    for n in range(4):
        h = (h[: len(code) - n] if n else h) * np.uint64(0x100000001B3) + (code[n:] + np.uint64(1)) * _SALT[n]
        live = live[: len(code) - n] & (code[n:] != 0)
        x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        cells.append((part[: len(x)] + ((x >> np.uint64(40)) % np.uint64(FEATURES)).astype(np.int64))[live])
    x = np.bincount(np.concatenate(cells), minlength=len(parts) * FEATURES).reshape(len(parts), FEATURES).astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def codewords(k: int, bits: int = BITS, seed: int = 5) -> np.ndarray:
    """k rows of +-1, the best separated of a fixed number of draws; every column has both signs where k > 1."""
    rng = np.random.default_rng(seed)
    best, least = None, -1
    for _ in range(300):
        m = rng.choice(np.array([-1, 1], np.float32), (k, bits))
        if k > 1:
            flat = np.abs(m.sum(0)) == k
            m[0, flat] *= -1
            apart = (bits - m @ m.T) / 2 + np.eye(k) * bits
            if apart.min() <= least:
                continue
            least = apart.min()
        best = m
        if k == 1:
            break
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit

    def signs(self, parts: list[str]) -> np.ndarray:
        """What each bit's classifier says, parts x bits; equal parts are asked once."""
        number: dict[str, int] = {}
        at = [number.setdefault(p, len(number)) for p in parts]
        once = list(number)
        return (np.concatenate([features(once[i : i + 256]) @ self.weights for i in range(0, len(once), 256)]) + self.bias)[at]

    def losses(self, parts: list[str], s: np.ndarray | None = None) -> np.ndarray:
        """Weighted squared hinge losses, parts x languages; `s` are the signs, if they are known."""
        s = self.signs(parts) if s is None else s
        up, down = np.square(np.maximum(0, 1 - s)) * self.trust, np.square(np.maximum(0, 1 + s)) * self.trust
        return up @ (self.code > 0).T.astype(np.float32) + down @ (self.code < 0).T.astype(np.float32)


def _sums(parts: list[str], y: np.ndarray, code: np.ndarray, at: np.ndarray, k: int, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of products of features, and of features and codewords, over the sentences `at`: of each of k languages, or weighted over all if k is 0."""
    size = FEATURES + 1
    gram, cross = np.zeros((k, size, size) if k else (size, size), np.float32 if k else np.float64), np.zeros((k, size, BITS) if k else (size, BITS))
    for lang in range(k) if k else [None]:
        mine = at if lang is None else at[y[at] == lang]
        for i in range(0, len(mine), 1000):
            rows = mine[i : i + 1000]
            x = np.concatenate([features([parts[j] for j in rows]), np.ones((len(rows), 1), np.float32)], 1)
            xw = x if lang is not None else x * share[y[rows]][:, None].astype(np.float32)
            to = ... if lang is None else lang
            gram[to] += xw.T @ x
            cross[to] += xw.T @ code[y[rows]]
    return gram, cross


def fit(parts: list[str], langs: list[str]) -> Model | None:
    """Three ridge fits of all bits, the later ones without sentences that contradict their label; None without sentences."""
    names = sorted(set(langs))
    if not names:
        return None
    y = np.array([names.index(x) for x in langs])
    code = codewords(len(names))
    use = np.ones(len(parts), bool)
    model = None
    grams = crosses = None  # of each language's sentences, from which a later fit takes out those it doesn't use
    for turn in range(3):
        # Languages weigh alike only once wrong labels are out: among few sentences they'd be many.
        count = np.bincount(y[use], minlength=len(names))
        share = np.sqrt(use.sum() / np.maximum(count, 1) / max(1, (count > 0).sum())) if turn else np.ones(len(names))
        at = np.flatnonzero(use)
        if grams is None or len(names) * (FEATURES + 1) ** 2 * 4 > GRAM_BYTES:
            grams, crosses = _sums(parts, y, code, at, len(names) if len(names) * (FEATURES + 1) ** 2 * 4 <= GRAM_BYTES else 0, share)
            inside = use.copy()
        else:
            for rows, sign in ((np.flatnonzero(inside & ~use), -1), (np.flatnonzero(use & ~inside), 1)):
                g, c = _sums(parts, y, code, rows, len(names), share)
                grams += sign * g
                crosses += sign * c
            inside = use.copy()
        gram, cross = (np.tensordot(share, grams, 1).astype(np.float64), np.tensordot(share, crosses, 1)) if grams.ndim == 3 else (grams.astype(np.float64), crosses)
        gram[np.diag_indices(FEATURES + 1)] += 1e-3 * len(at) / 50 + 0.5
        w = np.linalg.solve(gram, cross)
        model = Model(names, code, w[:-1].astype(np.float32), w[-1].astype(np.float32), np.ones(BITS, np.float32))
        signs = model.signs(parts)
        fine = model.losses(parts, signs).argmin(1) == y
        # A bit's trust is how often its sign was right on the sentences that were.
        hit = ((signs * code[y] > 0) & fine[:, None]).sum(0)
        acc = np.clip(hit / max(1, fine.sum()), 0.5, 0.999)
        model.trust = (np.log(acc / (1 - acc)) / np.log(999)).astype(np.float32) + 0.05
        use = fine if fine.any() else use
    return model


def segments(texts: list[str | None], model: Model) -> list[list[tuple[int, str, float, bool]]]:
    """Of each text (para_no, lang, confidence, ambiguous) of its prose paragraphs, after those of the document as number 0."""
    found: list[tuple[int, int]] = []  # (text, paragraph)
    known: dict[str, list[str]] = {}  # equal paragraphs are cut into sentences once
    parts: list[str] = []
    owner: list[int] = []
    for i, text in enumerate(texts):
        for no, para in paragraphs(text.replace("\r\n", "\n")) if text else ():
            s = known.get(para)
            if s is None:
                s = known[para] = sentences(para)
            if s:
                owner += [len(found)] * len(s)
                found.append((i, no))
                parts += s
    out: list[list[tuple[int, str, float, bool]]] = [[] for _ in texts]
    if not found:
        return out
    k, n = len(model.langs), len(found)
    loss = model.losses(parts)
    first, low = loss.argmin(1), loss.min(1)
    rest = np.partition(loss, 1, axis=1)[:, 1] if k > 1 else low + 1
    sure = (rest - low) / np.maximum(rest, 1e-9)
    letters = np.array([len(s) - s.count(" ") for s in parts], float)
    at = np.array(owner)
    # An unsure sentence weighs little; it decides only where all are unsure.
    votes = np.bincount(at * k + first, letters * np.where(sure < AMBIGUOUS, 0.05, 1.0), n * k).reshape(n, k)
    size = np.bincount(at, letters, n)
    best = np.zeros(n)
    np.maximum.at(best, at, sure)
    lang = votes.argmax(1)
    conf = votes.max(1) / np.maximum(votes.sum(1), 1e-9)
    doubt = (best < AMBIGUOUS) | (conf < 0.6)
    doc = np.array([i for i, _ in found])
    total = np.bincount(doc * k + lang, size, len(texts) * k).reshape(len(texts), k)
    main, whole = total.argmax(1), total.sum(1)
    for j, (i, no) in enumerate(found):
        if not out[i]:
            share = float(total[i, main[i]] / max(whole[i], 1e-9))
            out[i].append((0, model.langs[main[i]], round(share, 6), share < 0.6))
        out[i].append((no, model.langs[lang[j]], round(float(conf[j]), 6), bool(doubt[j])))
    return out


def train(df: DataFrame, key: str, text: str, label: str, aliases: DataFrame, per_lang: int = SAMPLE_DOCS) -> Model | None:
    """A model from at most `per_lang` labelled documents of each language of `aliases` (lang, alias).

    The documents are cut into sentences where they are; what comes to the driver is SAMPLE_SENTENCES sentences of
    SENTENCE_CHARS characters of each.
    """
    ship(df.sparkSession)
    known = aliases.select(F.col("lang").alias("known"), F.lower("alias").alias("alias")).distinct()
    rows = df.where(F.length(text) > 0).select(F.xxhash64(key).alias("h"), F.col(text).alias("text"), F.lower(label).alias("alias")).join(known, "alias")
    counts = rows.groupBy("known").count().collect()  # a row per language
    if not counts:
        return None

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for t in b.column(2).to_pylist():
                s = (x for _, p in paragraphs(t.replace("\r\n", "\n")) for x in sentences(p) if len(x) > 12 or _WIDE.search(x))
                parts.append([x[:SENTENCE_CHARS] for x in itertools.islice(s, SAMPLE_SENTENCES)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(parts, pa.list_(pa.string()))], ["known", "h", "parts"])

    share = F.create_map(*[F.lit(x) for r in counts for x in (r["known"], min(1.0, 1.3 * per_lang / r["count"]))])
    some = rows.where(F.pmod("h", F.lit(1 << 20)) < share[F.col("known")] * (1 << 20)).select("known", "h", "text")
    some = some.mapInArrow(cut_up, "known string, h long, parts array<string>")
    taken: dict[str, int] = {}
    parts, langs = [], []
    for r in some.orderBy("known", "h").limit(2 * per_lang * len(counts)).collect():
        if taken.get(r["known"], 0) < per_lang:
            taken[r["known"]] = taken.get(r["known"], 0) + 1
            parts += r["parts"]
            langs += [r["known"]] * len(r["parts"])
    return fit(parts, langs)


SCHEMA = "para_no long, lang string, confidence double, ambiguous boolean"


def detect(df: DataFrame, key: str, text: str, label: str, aliases: DataFrame, model: Model | None = None) -> DataFrame:
    """(key, label_lang, para_no, lang, confidence, ambiguous): one row per document with prose (para_no 0) and per prose paragraph.

    label_lang is the language the label stands for, ignoring case, or null. Null, empty and blank texts, and texts
    of code, traces, titles or repeated patterns alone, give no rows; repeated rows give repeated rows; without any
    labelled text there is no model and no row. One narrow stage after the fit.
    """
    ship(df.sparkSession)
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    model = model or train(df, key, text, label, aliases)
    if model is None:
        return spark.createDataFrame([], f"`{key}` {kind}, label_lang string, {SCHEMA}")
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            rows = [(at + i, *s) for at in range(0, len(texts), 512) for i, found in enumerate(segments(texts[at : at + 512], held.value)) for s in found]
            cols = list(zip(*rows)) if rows else [[]] * 5
            at = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.bool_())], [key, "label_lang", "para_no", "lang", "confidence", "ambiguous"])

    # A row per spelling of a label; Spark broadcasts it where its size allows.
    known = aliases.select(F.lower("alias").alias("__alias"), F.col("lang").alias("label_lang")).groupBy("__alias").agg(F.min("label_lang").alias("label_lang"))
    rows = df.select(F.col(key).alias(key), F.lower(label).alias("__alias"), F.col(text).alias("__text")).where("length(__text) > 0").join(known, "__alias", "left")
    return rows.select(key, "label_lang", "__text").mapInArrow(run, f"`{key}` {kind}, label_lang string, {SCHEMA}")


def mislabelled(found: DataFrame, key: str) -> DataFrame:
    """(key, para_no, lang): documents whose label isn't their language, and paragraphs in another language than their document."""
    docs = found.where((F.col("para_no") == 0) & ~F.col("label_lang").eqNullSafe(F.col("lang"))).select(key, "para_no", "lang")
    main = found.where("para_no = 0").select(F.col(key).alias("__key"), F.col("lang").alias("__main"))
    other = found.where("para_no > 0").join(main, F.col(key) == F.col("__key")).where(F.col("lang") != F.col("__main"))
    return docs.unionByName(other.select(key, "para_no", "lang"))
