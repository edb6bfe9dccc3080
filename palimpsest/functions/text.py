"""Column functions over text: tokens, windows, ids, names and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that separates tokens, the same in every engine.
WHITE = r"[ \t\n\r\f\x0B]"
SOLID = r"[^ \t\n\r\f\x0B]"
# Letters whose accents are folded, and their plain forms.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits with accents folded; everything else separates. Null for null."""
    folded = F.translate(F.lower(text), ACCENTED, PLAIN)
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def token_count(text: Column) -> Column:
    """Maximal runs of characters that are not white space."""
    return F.regexp_count(text, F.lit(SOLID + "+"))


def pieces(text: Column) -> Column:
    """Each token with the white space after it; leading white space is dropped."""
    return F.regexp_extract_all(text, F.lit(f"({SOLID}+{WHITE}*)"), 1)


def _join(parts: Column) -> Column:
    return F.regexp_replace(F.array_join(parts, ""), WHITE + "+$", "")


def windows(text: Column, target: int = 200, overlap: int = 30) -> Column:
    """Token windows as an array of (chunk_index, first_token, last_token, content).

    `target` is at least 50 and `overlap` below it; a window's own white space is kept and its ends are
    stripped. Null, empty and blank texts give an empty array.
    """
    target = max(50, target)
    overlap = min(max(0, overlap), target - 1)
    step = target - overlap
    p = F.coalesce(pieces(text), F.array().cast("array<string>"))
    last = F.greatest(F.size(p) - overlap - 1, F.lit(0))
    starts = F.when(F.size(p) > 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(
        starts,
        lambda s, i: F.struct(
            i.alias("chunk_index"),
            s.alias("first_token"),
            (F.least(s + target, F.size(p)) - 1).alias("last_token"),
            _join(F.slice(p, s + 1, target)).alias("content"),
        ),
    )


def window_lines(text: Column, target: int = 200, overlap: int = 30) -> Column:
    """As `windows`, with `skipped` and `inside`: the line breaks from a window's first token to the next window's, and to its own last token.

    The first window's `skipped` has those before its first token in `lead`. Every break is counted for one window
    only, so that a running sum over a text's windows gives their lines.
    """
    target = max(50, target)
    step = target - min(max(0, overlap), target - 1)
    p = pieces(text)
    breaks = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    part = lambda a, n: breaks(F.array_join(F.slice(p, a + 1, n), ""))
    return F.transform(
        windows(text, target, overlap),
        lambda w: F.struct(
            w["chunk_index"].alias("chunk_index"),
            w["first_token"].alias("first_token"),
            w["last_token"].alias("last_token"),
            w["content"].alias("content"),
            F.when(w["chunk_index"] == 0, breaks(F.regexp_extract(text, f"^{WHITE}*", 0))).otherwise(0).alias("lead"),
            part(w["first_token"], F.lit(step)).alias("skipped"),
            part(w["first_token"], w["last_token"] - w["first_token"]).alias("inside"),
        ),
    )


def valid_name(name: Column) -> Column:
    """A name of 1 to 200 printable characters."""
    return (F.length(F.trim(name)) > 0) & (F.length(name) <= 200) & ~name.rlike(r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]")


def truncate_tokens(text: Column, limit: int) -> Column:
    """The first `limit` tokens without the white space after them; a text that fits is returned as it is."""
    p = pieces(text)
    return F.when(F.size(p) <= limit, text).otherwise(_join(F.slice(p, 1, limit)))


def make_id(*parts: Column) -> Column:
    """sha256 over the parts, each followed by a zero byte."""
    out = [x for p in parts for x in (p.cast("string"), F.lit("\x00"))]
    return F.sha2(F.concat(*out), 256)


def slug(name: Column) -> Column:
    """Lower-case letters and digits joined by single underscores; `project` where nothing is left."""
    s = F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    return F.when(s == "", "project").otherwise(s)


def trim_content(text: Column, limit: int = 1200) -> Column:
    """At most `limit` characters, with an ellipsis where some are cut; 0 is no limit, negative the default."""
    limit = 1200 if limit < 0 else min(limit, 100_000)
    return text if limit == 0 else F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def sanitize_section(name: Column) -> Column:
    """Word characters and hyphens only."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}_\-]", "")


# Messages that say nothing about a change, and what each tag is recognised by.
NOISE = r"^bump version|^merge branch|^merge pull request|^wip$|^update changelog|^version \d"
TAGS = {
    "fix": "fix|fixes|fixed|bugfix",
    "refactor": "refactor|refactoring",
    "perf": "perf|performance|optimize",
    "feat": "feat|feature|add",
    "docs": "docs|documentation",
    "test": "test|tests|testing",
    "style": "style|formatting",
    "chore": "chore",
}


def is_meaningful(message: Column) -> Column:
    """A message of ten characters or more that is not noise."""
    m = F.trim(F.lower(message))
    return (F.length(m) >= 10) & ~m.rlike(NOISE)


def commit_tags(message: Column) -> Column:
    """The tags whose words occur in a message."""
    m = F.lower(message)
    return F.filter(F.array(*[F.when(m.rlike(rf"\b({words})\b"), F.lit(tag)) for tag, words in TAGS.items()]), lambda t: t.isNotNull())


def candidate_symbols(text: Column) -> Column:
    """Identifiers that look like symbols: long ones, ones with underscores, or with capitals."""
    found = F.regexp_extract_all(text, F.lit("([A-Za-z_][A-Za-z0-9_]*)"), 1)
    return F.filter(found, lambda t: (F.length(t) >= 4) | t.contains("_") | t.rlike("^[A-Z].") | t.rlike("^.+[A-Z]"))


# What a project id may look like, and names that Windows keeps for devices.
PROJECT_ID = r"^[a-zA-Z0-9_-]+$"
DEVICES = r"(?i)^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(\.|$)"


def valid_project_id(value: Column) -> Column:
    return value.rlike(PROJECT_ID) & ~value.rlike(DEVICES)


def safe_metadata(raw: Column) -> Column:
    """A JSON object's text; where it is no object, one that marks the row private. Null counts as an empty object."""
    kind = F.json_object_keys(raw).isNotNull() & F.trim(raw).startswith("{")
    return F.when(raw.isNull() | (F.trim(raw) == ""), F.lit("{}")).when(kind & F.try_parse_json(raw).isNotNull(), raw).otherwise(F.lit('{"_metadata_decode_error": true, "private": true}'))
