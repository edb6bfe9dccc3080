"""Generated, minified, vendored and blob files by belief propagation over directory trees.

Every file and directory is a variable with five labels. What is known of a
file, from its name and its chunks, and of a directory, from its name, is evidence. A
parent's label makes some labels of its children likelier. The factors form trees,
so one pass from the leaves to the roots and one back give exact marginals.

Files with the same signs in one directory send the same message, so a directory counts them by
signs, and only those counts enter the passes. A forest of whole directory trees is one task's work, level by level in
numpy. Trees above a limit are cut: what hangs below their upper directories are blocks
of their own, which send one message up and get one back, so the number of jobs depends neither on the depth nor on the files.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship

HAND, GENERATED, MINIFIED, VENDORED, BLOB = range(5)
LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
#: P(child's label | parent directory's label), parents in rows. Single generated files and blobs stand in
#: hand-written directories, while third-party copies come as directories.
FILE_IN = (
    (0.91, 0.04, 0.01, 0.01, 0.03),
    (0.06, 0.90, 0.01, 0.02, 0.01),
    (0.05, 0.01, 0.91, 0.02, 0.01),
    (0.03, 0.01, 0.02, 0.93, 0.01),
    (0.20, 0.02, 0.02, 0.02, 0.74),
)
DIR_IN = (
    (0.963, 0.005, 0.01, 0.02, 0.002),
    *FILE_IN[1:],
)
ROOT = (0.996, 0.001, 0.001, 0.001, 0.001)

#: Names of directories that hold third-party copies, generated or minified files.
VENDORED_DIRS = ("node_modules", "vendor", "_vendor", "third_party", "thirdparty", "third-party", "3rdparty", "external", "extern", "externals", "deps", "bower_components", "jspm_packages", "site-packages", "dist-packages", "venv", ".venv", "pods", "carthage", "godeps")
GENERATED_DIRS = ("generated", "__generated__", "generated-sources", "generated_sources", "autogen", "gen-src", "__pycache__")
MINIFIED_DIRS = ("dist",)
LOCK_FILES = ("package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "pipfile.lock", "uv.lock", "pdm.lock", "cargo.lock", "go.sum", "composer.lock", "gemfile.lock", "mix.lock", "flake.lock", "pubspec.lock", "podfile.lock", "packages.lock.json")
_GENERATED_NAME = r"(?:_pb2(?:_grpc)?\.pyi?|\.pb\.(?:go|cc|h|c)|\.pb\.gw\.go|\.g\.(?:ts|dart|cs|js)|\.designer\.(?:cs|vb)|\.generated\.[a-z]+|[._-]generated\.[a-z]+|\.gen\.[a-z]+)$"
_MINIFIED_NAME = r"(?:[.-]min\.(?:js|css|mjs|cjs)|\.bundle\.(?:js|css)|[.-][0-9a-f]{8,20}\.(?:chunk\.)?(?:js|css|mjs))$"
#: Directories with files below a directory up to which its tree is one block, and directories of one task.
BLOCK_DIRS, SHARD_DIRS = 50_000, 5_000
#: The part of digits from which on a code file of some length holds mostly numbers, and that length.
DIGITS, DIGITS_CHARS = 0.25, 400
#: Files whose long lines are no sign of a minifier, nor digits of embedded data.
_PLAIN_EXT = r"\.(?:md|rst|txt|json|jsonl|ya?ml|toml|ini|cfg|conf|env|csv|tsv|xml|sql|lock|svg|ipynb)$"

# A banner stands in a comment of its own; strings in code and sentences that mention one do not start like this.
_COMMENT = r'(?im)^[ \t]*(?:\{\s*"_comment"\s*:\s*"|//+!?|#+|--|/\*+!?|\*|<!--|;+|%+)[ \t]*'
_GENERATED_BANNER = _COMMENT + r"(?:code generated\b|@generated\b|<auto-?generated|auto-?generated (?:file|by|from|code|using)|auto generated by\b|(?:this file (?:was|is) )?(?:automatically|machine)[ -](?:generated|written)\b|this file (?:was|is) (?:auto-?)?generated\b|generated (?:on|from|by|with|automatically)\b|end of file generated\b|emitted by \S+, do not|(?:produced|created|written|built|made) by \S+[;,.:] .*\b(?:edits?|changes?)\b.*\b(?:overwritten|lost|replaced|discarded)\b|(?:any |all |your |manual |hand )?(?:edits?|changes?)(?: (?:made )?(?:here|to this file|in this file))? (?:will be|are|get) (?:overwritten|lost|replaced|discarded)\b|do not (?:edit|modify|change)\b)"
_VENDORED_BANNER = _COMMENT + r"(?:vendored from\b|copied verbatim from\b|this copy of \S+ tracks\b|upstream project\b|\S+ v?\d+\.\d+(?:\.\d+)?\S* (?:--|-|\|)+ *(?:upstream|released under|licensed|\(c\)|copyright|https?:))"
_DATA = r"[A-Za-z0-9+/=]{60,}|0[xX][0-9a-fA-F]{1,2},[ \n]?|(?<![\w.])-?\d+(?:\.\d+)?,[ \n]?|\\x[0-9a-fA-F]{2}"


def chunk_signs(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chars, spaces, lines, data, digits, generated, vendored) of every non-empty text, over whole texts."""
    t = F.col(text)
    rows = chunks.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(
        F.col(key).alias("chunk"),
        F.length(t).cast("long").alias("chars"),
        (F.length(t) - F.length(F.translate(t, " \t\r\n", ""))).cast("long").alias("spaces"),
        (F.length(t) - F.length(F.translate(t, "\n", "")) + 1).cast("long").alias("lines"),
        (F.length(t) - F.length(F.regexp_replace(t, _DATA, ""))).cast("long").alias("data"),
        (F.length(t) - F.length(F.translate(t, "0123456789", ""))).cast("long").alias("digits"),
        t.rlike(_GENERATED_BANNER).alias("generated"),
        t.rlike(_VENDORED_BANNER).alias("vendored"),
    )
    return rows.dropDuplicates(["chunk"])


#: What each sign of a file says: the likelihood of it, where it holds, by label. A file's signs are bits in this order.
FILE_SIGNS = {
    "vendored directory": (0.01, 0.05, 0.2, 1, 0.1),
    "generated directory": (0.01, 1, 0.1, 0.1, 0.1),
    "lock file": (0.001, 1, 0.01, 0.01, 0.01),
    "generated name": (0.004, 1, 0.02, 0.05, 0.02),
    "minified name": (0.004, 0.05, 1, 0.05, 0.02),
    "generated banner": (0.002, 1, 0.02, 0.05, 0.02),
    "vendored banner": (0.002, 0.02, 0.05, 1, 0.02),
    "data": (0.002, 0.02, 0.02, 0.02, 1),
    "dense": (0.002, 0.02, 1, 0.05, 0.02),
    "plain": (1, 0.1, 0.02, 0.5, 0.01),  # third-party code looks hand-written
}
#: The same of a directory's own name.
DIR_SIGNS = ((VENDORED_DIRS, (1e-4, 0.01, 0.02, 1, 0.01)), (GENERATED_DIRS, (1e-4, 1, 0.02, 0.02, 0.02)), (MINIFIED_DIRS, (0.05, 0.2, 1, 0.1, 0.05)))


def log_sum(x: np.ndarray) -> np.ndarray:
    """log of the sum of exponents over the last axis."""
    top = x.max(-1)
    return top + np.log(np.exp(x - top[..., None]).sum(-1))


def to_parent(belief: np.ndarray, likely: tuple) -> np.ndarray:
    """The messages of children with these beliefs to their parents, by the parent's label."""
    return log_sum(belief[:, None, :] + np.log(np.array(likely))[None])


def from_parent(rest: np.ndarray, likely: tuple) -> np.ndarray:
    """The messages to children, by their label, of parents whose beliefs without the child's own message are these."""
    return log_sum(rest[:, None, :] + np.log(np.array(likely)).T[None])


@lru_cache(maxsize=1)
def file_beliefs() -> np.ndarray:
    """What the signs of a file say, for every set of signs."""
    each = np.log(np.array(list(FILE_SIGNS.values())))
    bits = (np.arange(1 << len(each))[:, None] >> np.arange(len(each))) & 1
    return bits @ each


def _named(name: str) -> np.ndarray:
    out = np.zeros(5)
    for names, likely in DIR_SIGNS:
        if name in names:
            out += np.log(likely)
    return out


def _texts(values: Iterable[str]) -> pd.Series:
    """A column of strings, even of none: the column of an empty list is numbers, at which the conversion to Arrow fails."""
    return pd.Series(list(values), dtype=object)


_DECIDES = frozenset((*VENDORED_DIRS, *GENERATED_DIRS))


class Forest:
    """Directories (group, path) with the counts of their files' signs; parents that are not among them are outside.

    `held` are messages that come from below, of blocks that were cut off: rows of (group, directory) and five numbers.
    """

    def __init__(self, group: np.ndarray, path: np.ndarray, signs: np.ndarray, n: np.ndarray, held: pd.DataFrame | None = None):
        keys = list(zip(group.tolist(), path.tolist()))
        self.dirs = sorted(set(keys), key=lambda k: (k[1].count("/") + 1 if k[1] else 0, k))
        at = {k: i for i, k in enumerate(self.dirs)}
        self.depth = np.array([p.count("/") + 1 if p else 0 for _, p in self.dirs])
        self.up = np.array([at.get((g, p.rpartition("/")[0]), -1) if p else -1 for g, p in self.dirs])
        self.free = np.array([p.rpartition("/")[2] not in _DECIDES for _, p in self.dirs])
        names = {}
        self.belief = np.array([names.setdefault(x, _named(x)) for x in (p.rpartition("/")[2] for _, p in self.dirs)])
        self.belief[self.depth == 0] += np.log(ROOT)
        self.own = np.array([at[k] for k in keys])
        self.signs, self.n = signs, n
        some = signs >= 0
        np.add.at(self.belief, self.own[some], to_parent(file_beliefs(), FILE_IN)[signs[some]] * n[some, None])
        if held is not None and len(held):
            rows = [at[k] for k in zip(held["g"], held["dir"])]
            np.add.at(self.belief, rows, held[["m0", "m1", "m2", "m3", "m4"]].to_numpy())
        self.levels = [np.flatnonzero(self.depth == d) for d in range(int(self.depth.max()) + 1)]

    def upward(self) -> np.ndarray:
        """The message of every directory to its parent; one whose name decides says nothing about the one it stands in."""
        self.sent = np.zeros_like(self.belief)
        for rows in self.levels[::-1]:
            self.sent[rows] = np.where(self.free[rows, None], to_parent(self.belief[rows], DIR_IN), 0.0)
            inside = rows[self.up[rows] >= 0]
            np.add.at(self.belief, self.up[inside], self.sent[inside])
        return self.sent

    def downward(self, outside: dict | None = None) -> np.ndarray:
        """The belief of every directory in all that is known; `outside` has what the parents of the forest's roots believe without them."""
        self.total = self.belief.copy()
        for rows in self.levels:
            inside = rows[self.up[rows] >= 0]
            self.total[inside] += from_parent(self.total[self.up[inside]] - self.sent[inside], DIR_IN)
            if outside:
                roots = [i for i in rows[self.up[rows] < 0].tolist() if self.dirs[i] in outside]
                if roots:
                    self.total[roots] += from_parent(np.array([outside[self.dirs[i]] for i in roots]), DIR_IN)
        return self.total

    def labels(self) -> pd.DataFrame:
        """(g, dir, signs, label, confidence) of the files of each directory by their signs."""
        some = np.flatnonzero(self.signs >= 0)
        mine, whole = self.signs[some], self.total[self.own[some]]
        final = file_beliefs()[mine] + from_parent(whole - to_parent(file_beliefs(), FILE_IN)[mine], FILE_IN)
        best = final.argmax(1)
        sure = 1 / np.exp(final - final.max(1, keepdims=True)).sum(1)
        keys = [self.dirs[i] for i in self.own[some].tolist()]
        return pd.DataFrame({"g": _texts(k[0] for k in keys), "dir": _texts(k[1] for k in keys), "signs": mine, "label": np.array(LABELS, object)[best], "confidence": sure})


def _signs(real: DataFrame) -> Column:
    """The signs of files with name, dir and the sums of their chunks, as bits in the order of FILE_SIGNS."""
    has = F.col("chars") > 0
    plain = F.col("name").rlike(_PLAIN_EXT)
    many = (F.col("digits") >= DIGITS * F.col("chars")) & (F.col("chars") >= DIGITS_CHARS)
    dense = has & ~plain & (F.col("chars") / F.col("lines") >= 160) & (F.col("spaces") < 0.09 * F.col("chars"))
    data = has & (~plain & (F.col("data") >= 0.6 * F.col("chars")) | many & (~plain | F.col("name").endswith(".sql")))
    gen, ven = F.coalesce("generated", F.lit(False)), F.coalesce("vendored", F.lit(False))
    segments = F.split("dir", "/")
    held = {
        "vendored directory": F.arrays_overlap(segments, F.array(*map(F.lit, VENDORED_DIRS))),
        "generated directory": F.arrays_overlap(segments, F.array(*map(F.lit, GENERATED_DIRS))),
        "lock file": F.col("name").isin(*LOCK_FILES),
        "generated name": F.col("name").rlike(_GENERATED_NAME),
        "minified name": F.col("name").rlike(_MINIFIED_NAME),
        "generated banner": gen,
        "vendored banner": ven & ~gen,
        "data": data,
        "dense": dense & ~data,
        "plain": has & ~gen & ~ven & ~dense & ~data,
    }
    return sum((F.when(held[name], 1 << i).otherwise(0) for i, name in enumerate(FILE_SIGNS)), F.lit(0))


def _above(path: Column) -> Column:
    """A directory and all those above it, from the root "" down."""
    parts = F.split(path, "/")
    return F.when(path == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))))


def label_files(files: DataFrame, links: DataFrame, chunks: DataFrame, group: str = "project_id", path: str = "file_path", chunk: str = "chunk_id", text: str = "content", virtual: str = "vfs://", block_dirs: int = BLOCK_DIRS) -> DataFrame:
    """(group, path, label, confidence) of every file of `files`, paths as stored.

    `links` (group, path, chunk) ties files to `chunks` (chunk, text). Files without chunks, and null or empty texts, are
    judged by name and neighbours; virtual paths are hand-written; null groups or paths are left out; repeated
    rows are one; an empty table gives no rows. Separators may be / or \\, with or without a leading ./.
    """
    ship(files.sparkSession)
    every = files.where(F.col(group).isNotNull() & F.col(path).isNotNull()).select(F.col(group).alias("g"), F.col(path).alias("p")).distinct()
    ties = links.select(F.col(group).alias("g"), F.col(path).alias("p"), F.col(chunk).alias("chunk")).where("g is not null and p is not null and chunk is not null").distinct()
    signs = ties.join(chunk_signs(chunks, chunk, text), "chunk").groupBy("g", "p").agg(*[F.sum(c).alias(c) for c in ("chars", "spaces", "lines", "data", "digits")], F.max("generated").alias("generated"), F.max("vendored").alias("vendored"))
    real = every.where(~F.col("p").startswith(virtual)).join(signs, ["g", "p"], "left")
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("p", r"\\", "/"), r"^(?:\./)+", ""), "/{2,}", "/")
    real = real.withColumn("at", F.lower(clean)).withColumn("name", F.element_at(F.split("at", "/"), -1))
    real = real.withColumn("dir", F.when(F.instr("at", "/") > 0, F.regexp_replace("at", "/[^/]*$", "")).otherwise(""))
    leaves = cut(real.select("g", "p", "dir", _signs(real).cast("int").alias("signs")))
    counts = leaves.groupBy("g", "dir", "signs").agg(F.count("*").alias("n"))
    # All directories, from the root "" down, each with the directories with files at or below it.
    tree = cut(counts.select("g", "dir").distinct().select("g", F.explode(_above(F.col("dir"))).alias("dir")).groupBy("g", "dir").agg(F.count("*").alias("w")))
    size = tree.agg(F.count("*"), F.max("w")).first()
    rows = counts.unionByName(tree.select("g", "dir", F.lit(-1).alias("signs"), F.lit(0).cast("long").alias("n")))
    shards = max(1, math.ceil(size[0] / SHARD_DIRS))
    final = _by_tree(rows, shards) if (size[1] or 0) <= block_dirs else _by_blocks(rows, tree, shards, block_dirs)
    labelled = leaves.join(final, ["g", "dir", "signs"]).select(F.col("g").alias(group), F.col("p").alias(path), "label", "confidence")
    unreal = every.where(F.col("p").startswith(virtual)).select(F.col("g").alias(group), F.col("p").alias(path), F.lit(LABELS[HAND]).alias("label"), F.lit(1.0).alias("confidence"))
    return labelled.unionByName(unreal)


_LABELLED = "g string, dir string, signs int, label string, confidence double"


def _by_tree(rows: DataFrame, shards: int) -> DataFrame:
    """Labels of forests of whole trees."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Forest(pdf["g"].to_numpy(), pdf["dir"].to_numpy(), pdf["signs"].to_numpy(), pdf["n"].to_numpy())
        f.upward()
        f.downward()
        return f.labels()

    return rows.withColumn("shard", F.pmod(F.xxhash64("g"), F.lit(shards))).groupBy("shard").applyInPandas(run, _LABELLED)


def _by_blocks(rows: DataFrame, tree: DataFrame, shards: int, limit: int) -> DataFrame:
    """Labels of trees of which those above the limit are cut into an upper part and blocks.

    A directory is in the upper part if more than `limit` directories with files lie at or below it, so that a tree's upper part
    has at most depth / limit of its directories; the highest directory that isn't is the root of a block.
    """
    high = tree.where(F.col("w") > limit).select("g", "dir")
    over = tree.select("g", "dir", F.explode(_above(F.col("dir"))).alias("a")).join(high.select("g", F.col("dir").alias("a")), ["g", "a"])
    deepest = over.groupBy("g", "dir").agg(F.max(F.when(F.col("a") == "", 0).otherwise(F.size(F.split("a", "/")))).alias("top"))
    part = F.split("dir", "/")
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(part))
    block = F.when(F.col("top").isNull(), "").when(depth <= F.col("top"), F.lit(None)).otherwise(F.array_join(F.slice(part, 1, F.col("top") + 1), "/"))
    placed = cut(rows.join(tree.select("g", "dir").join(deepest, ["g", "dir"], "left").select("g", "dir", block.alias("block")), ["g", "dir"]))
    upper, lower = placed.where("block is null"), placed.where("block is not null").withColumn("shard", F.pmod(F.xxhash64("g", "block"), F.lit(shards)))
    numbers = ", ".join(f"m{i} double" for i in range(5))

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Forest(pdf["g"].to_numpy(), pdf["dir"].to_numpy(), pdf["signs"].to_numpy(), pdf["n"].to_numpy())
        sent = f.upward()
        roots = [i for i in range(len(f.dirs)) if f.up[i] < 0 and f.dirs[i][1]]
        out = pd.DataFrame(sent[roots], columns=[f"m{i}" for i in range(5)])
        out.insert(0, "g", _texts(f.dirs[i][0] for i in roots))
        out.insert(1, "block", _texts(f.dirs[i][1] for i in roots))
        return out

    sent = cut(lower.groupBy("shard").applyInPandas(send, f"g string, block string, {numbers}"))
    # Sums of what comes from below, before anything of it meets in a task.
    into = F.when(F.instr("block", "/") > 0, F.regexp_replace("block", "/[^/]*$", "")).otherwise("")
    below = sent.groupBy("g", into.alias("dir")).agg(*[F.sum(f"m{i}").alias(f"m{i}") for i in range(5)])
    tops = upper.select("g", "dir", "signs", "n", *[F.lit(None).cast("double").alias(f"m{i}") for i in range(5)])
    tops = tops.unionByName(below.join(high, ["g", "dir"]).select("g", "dir", F.lit(-1).alias("signs"), F.lit(0).cast("long").alias("n"), *[f"m{i}" for i in range(5)]))

    def middle(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Forest(pdf["g"].to_numpy(), pdf["dir"].to_numpy(), pdf["signs"].to_numpy(), pdf["n"].to_numpy(), pdf[pdf["m0"].notna()])
        f.upward()
        total = f.downward()
        out = f.labels().assign(**{f"m{i}": np.nan for i in range(5)})
        believed = pd.DataFrame(total, columns=[f"m{i}" for i in range(5)]).assign(g=[k[0] for k in f.dirs], dir=[k[1] for k in f.dirs], signs=-1, label=None, confidence=np.nan)
        return pd.concat([out, believed[out.columns]], ignore_index=True)

    mid = cut(tops.groupBy("g").applyInPandas(middle, f"{_LABELLED}, {numbers}"))
    over = mid.where("signs = -1").select("g", "dir", *[F.col(f"m{i}").alias(f"t{i}") for i in range(5)])
    back = sent.withColumn("dir", into).join(over, ["g", "dir"]).select("g", "block", *[(F.col(f"t{i}") - F.col(f"m{i}")).alias(f"m{i}") for i in range(5)])
    fed = lower.select("g", "dir", "signs", "n", "shard", *[F.lit(None).cast("double").alias(f"m{i}") for i in range(5)])
    fed = fed.unionByName(back.select("g", F.col("block").alias("dir"), F.lit(-1).alias("signs"), F.lit(0).cast("long").alias("n"), F.pmod(F.xxhash64("g", "block"), F.lit(shards)).alias("shard"), *[f"m{i}" for i in range(5)]))

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        told = pdf["m0"].notna()
        own = pdf[~told]
        f = Forest(own["g"].to_numpy(), own["dir"].to_numpy(), own["signs"].to_numpy(), own["n"].to_numpy())
        f.upward()
        rest = pdf[told]
        f.downward(dict(zip(zip(rest["g"], rest["dir"]), rest[[f"m{i}" for i in range(5)]].to_numpy())))
        return f.labels()

    return mid.where("signs >= 0").select("g", "dir", "signs", "label", "confidence").unionByName(fed.groupBy("shard").applyInPandas(finish, _LABELLED))
