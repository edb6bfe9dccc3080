"""Git history: parsing logs and diffs, co-change, reverts and rules drawn from them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut
from . import fts, fusion, vector
from .pairs import pairs_within

MARKER = "===COMMIT_START==="
# Fixed value: what a rule drawn from a revert says.
RULE = (
    "CRITICAL: Anti-pattern detected from reverted commit {short}.\n\n"
    "Original commit: '{bad}'\n"
    "This commit was REVERTED because it caused a regression.\n\n"
    "Affected files: {files}\n"
    "{more}\n\n"
    "Before making similar changes, review why this was reverted:\n"
    "Revert message: '{undo}'\n\n"
    "Recommendation: Search git history for this commit to understand the failure."
)
DIFF_CHARS, DIFF_CUT = 2000, "\n... (truncated)"


def unquoted(path: Column) -> Column:
    """A path as it is, of the text between the quotes that git puts around odd ones."""
    return F.replace(F.replace(F.replace(path, F.lit("\\\\"), F.lit("\\")), F.lit('\\"'), F.lit('"')), F.lit("\\t"), F.lit("\t"))


def diff_path(diff: Column) -> Column:
    """The path of a diff: after +++ b/, else of a binary line, else after --- a/, among its first 15 lines; quoted ones without their escapes, and without the tab that ends one with blanks."""
    head = F.substring_index(diff, "\n", 15)
    get = lambda pattern: F.regexp_extract(head, pattern, 1)
    found = lambda c: F.when(c != "", c)
    quoted = lambda mark: found(unquoted(F.regexp_replace(get(rf'(?:^|\n){mark}([^\n]*?)\t?(?:\n|$)'), '"$', "")))
    return F.coalesce(
        found(get(r"(?:^|\n)\+\+\+ b/([^\n]*?)\t?(?:\n|$)")), quoted(r'\+\+\+ "b/'),
        found(get(r"(?:^|\n)Binary files? a/[^\n]+ and b/([^\n]+) differ(?:\n|$)")),
        found(get(r"(?:^|\n)--- a/([^\n]*?)\t?(?:\n|$)")), quoted(r'--- "a/'),
    )


def parse_sections(df: DataFrame, section: str) -> DataFrame:
    """(commit_hash, author, timestamp, message, body) of log sections `hash|author|epoch|subject` and a body.

    Sections without four header parts or a whole number as time, and null ones, give no row.
    """
    s = F.regexp_replace(F.col(section), "^\\s*(?:" + MARKER + ")?", "")
    header = F.split(F.substring_index(s, "\n", 1), r"\|", 4)
    rows = df.where(F.col(section).contains("\n")).select(header.alias("h"), s.alias("s"))
    rows = rows.withColumn("body", F.substring(F.col("s"), F.length(F.substring_index("s", "\n", 1)) + 2, F.length("s")))
    rows = rows.where((F.size("h") == 4) & F.col("h")[2].rlike(r"^\d+$"))
    return rows.select(F.col("h")[0].alias("commit_hash"), F.col("h")[1].alias("author"), F.col("h")[2].cast("long").alias("timestamp"), F.trim(F.col("h")[3]).alias("message"), "body")


def parse_diffs(sections: DataFrame) -> DataFrame:
    """(commit_hash, file_path, change_type, diff_content) of parsed sections: a row per diff block with a path.

    A name-status or raw list before the first block gives the change; renames and copies count by their new path. Blocks over 2,000
    characters are cut, with a note.
    """
    marked = F.concat(F.lit("\n"), F.col("body"))
    blocks = F.split(marked, "\ndiff --git ")
    status = F.filter(F.split(blocks[0], "\n"), lambda x: x.contains("\t"))
    bare = lambda p: F.when(p.startswith('"'), unquoted(F.regexp_replace(p, '^"|"$', ""))).otherwise(p)
    pairs = F.transform(status, lambda x: F.named_struct(F.lit("path"), bare(F.element_at(F.split(x, "\t"), -1)), F.lit("kind"), F.regexp_extract(F.trim(x), r"^(?::[^\t]* )?([A-Z])", 1)))
    rows = sections.select("commit_hash", pairs.alias("pairs"), F.explode(F.slice(blocks, 2, F.greatest(F.size(blocks), F.lit(1)))).alias("block"))
    rows = rows.withColumn("block", F.concat(F.lit("diff --git "), F.col("block")))
    rows = rows.withColumn("file_path", diff_path(F.col("block"))).where("file_path is not null")
    kind = F.try_element_at(F.filter("pairs", lambda p: p["path"] == F.col("file_path")), F.lit(-1))["kind"]
    change = F.when(kind == "A", "ADDED").when(kind == "D", "DELETED").otherwise("MODIFIED")
    cut = F.when(F.length("block") > DIFF_CHARS, F.concat(F.substring("block", 1, DIFF_CHARS), F.lit(DIFF_CUT))).otherwise(F.col("block"))
    return rows.select("commit_hash", "file_path", change.alias("change_type"), cut.alias("diff_content"))


def couplings(diffs: DataFrame, commits: DataFrame, min_frequency: int = 5, recent: int = 2000) -> DataFrame:
    """(project_id, file_a, file_b, frequency): files changed in the same of a project's last `recent` commits.

    Files in fewer than `min_frequency` of those commits are in no pair and are dropped before pairs are made.
    """
    w = Window.partitionBy("project_id").orderBy(F.desc("timestamp"), "commit_hash")
    last = commits.where("project_id is not null").withColumn("r", F.row_number().over(w)).where(F.col("r") <= recent).select("project_id", "commit_hash")
    rows = diffs.where("file_path is not null").select("commit_hash", "file_path").distinct().join(last, "commit_hash")
    often = rows.groupBy("project_id", "file_path").count().where(F.col("count") >= min_frequency).drop("count")
    rows = rows.join(often, ["project_id", "file_path"])
    pairs = pairs_within(rows, ["project_id", "commit_hash"], "file_path").select("project_id", F.col("file_path_a").alias("file_a"), F.col("file_path_b").alias("file_b"))
    return pairs.groupBy("project_id", "file_a", "file_b").agg(F.count("*").alias("frequency")).where(F.col("frequency") >= min_frequency)


def coupling_commits(pairs: DataFrame, diffs: DataFrame, commits: DataFrame, keep: int = 3) -> DataFrame:
    """(project_id, file_a, file_b, commit_hash, message, rn): the newest `keep` commits of each pair."""
    rows = diffs.where("file_path is not null").select("commit_hash", "file_path").distinct().join(commits.select("commit_hash", "project_id", "timestamp", "message"), "commit_hash")
    a = pairs.join(rows.withColumnRenamed("file_path", "file_a"), ["project_id", "file_a"])
    b = rows.select("project_id", F.col("file_path").alias("file_b"), "commit_hash")
    both = a.join(b, ["project_id", "file_b", "commit_hash"])
    w = Window.partitionBy("project_id", "file_a", "file_b").orderBy(F.desc("timestamp"), "commit_hash")
    return both.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= keep).select("project_id", "file_a", "file_b", "commit_hash", "message", "rn")


def detect_reverts(message: Column) -> Column:
    """(text, hash, message) of a revert's subject, null for others."""
    m = F.lower(F.trim(message))
    told = F.regexp_extract(m, "^revert[:\\s]+[\"']?(.+?)[\"']?$", 1)
    body = F.regexp_extract(m, r"this reverts commit\s+([a-f0-9]{7,40})", 1)
    text = F.when(told != "", told).when(body != "", body)
    digest = F.regexp_extract(text, "([a-f0-9]{7,40})", 1)
    return F.when(text.isNotNull(), F.struct(text.alias("text"), F.when(digest != "", digest).alias("hash"), F.when(digest == "", text).alias("message")))


def revert_pairs(commits: DataFrame, last: int = 1000) -> DataFrame:
    """(project_id, revert_hash, original_hash): reverts and the newest older commit that they name, by hash or by words that its message holds.

    Both among a project's `last` newest commits, which bounds what meets: at most `last` commits of a project, however many it has.
    """
    w = Window.partitionBy("project_id").orderBy(F.desc_nulls_last("timestamp"), "commit_hash")
    rows = commits.where("project_id is not null").withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= last).where("message is not null and timestamp is not null")
    reverts = rows.withColumn("r", detect_reverts(F.col("message"))).where("r is not null").select("project_id", F.col("commit_hash").alias("revert_hash"), F.col("timestamp").alias("at"), F.col("r.hash").alias("digest"), F.col("r.message").alias("said"))
    older = rows.select("project_id", F.col("commit_hash").alias("original_hash"), F.col("timestamp").alias("was"), F.lower("message").alias("subject"))
    named = F.coalesce(F.when(F.col("digest").isNotNull(), F.col("original_hash").startswith(F.col("digest"))), F.col("subject").contains(F.col("said")))
    both = reverts.join(older, "project_id").where((F.col("was") < F.col("at")) & (F.col("original_hash") != F.col("revert_hash")) & named)
    return both.groupBy("project_id", "revert_hash").agg(F.min_by("original_hash", F.struct(-F.col("was"), F.col("original_hash"))).alias("original_hash"))


def revert_rules(pairs: DataFrame, commits: DataFrame, diffs: DataFrame) -> DataFrame:
    """(rule_id, project_id, file_pattern, rule_text, priority) for reverted commits that have diffs."""
    files = diffs.where("file_path is not null").groupBy("commit_hash").agg(F.sort_array(F.collect_set("file_path")).alias("files"))
    text = commits.select(F.col("commit_hash"), F.col("message"))
    rows = pairs.join(files.withColumnRenamed("commit_hash", "original_hash"), "original_hash")
    rows = rows.join(text.select(F.col("commit_hash").alias("original_hash"), F.col("message").alias("bad")), "original_hash").join(text.select(F.col("commit_hash").alias("revert_hash"), F.col("message").alias("undo")), "revert_hash")
    parts = {
        "short": F.substring("original_hash", 1, 8), "bad": F.col("bad"), "files": F.array_join(F.slice("files", 1, 3), ", "),
        "more": F.when(F.size("files") > 3, "...").otherwise(""), "undo": F.col("undo"),
    }
    rule = F.concat(*[parts[x[1:-1]] if x[:1] == "{" else F.lit(x) for x in re.split(r"(\{\w+\})", RULE)])
    out = rows.select(F.concat(F.lit("immune_system_"), F.substring("original_hash", 1, 12)).alias("rule_id"), "project_id", F.array_join(F.slice("files", 1, 5), "|").alias("file_pattern"), rule.alias("rule_text"), F.lit(10).alias("priority"))
    return out.groupBy("rule_id", "project_id", "file_pattern", "priority").agg(F.min("rule_text").alias("rule_text"))


def search(spark: SparkSession, commits: DataFrame, diffs: DataFrame, tags: DataFrame, vectors: DataFrame, query: str, query_vector: list[float], file_filter: str | None = None, limit: int = 5) -> DataFrame:
    """(commit_hash, score, lex_rank, vec_rank, author, timestamp, message, diffs, tags): commits by message and by vector, fused.

    `vectors` are (commit_hash, vector) as stored. With `file_filter` only commits count that touch a path holding it, and only such
    diffs come out: the first five by path, 500 characters of each. Commits without a message have no words; repeated diffs are one.
    """
    if file_filter:
        diffs = diffs.where(F.col("file_path").contains(file_filter))
        commits = cut(commits.join(diffs.select("commit_hash").distinct(), "commit_hash", "left_semi"))
    lex = fusion.ranked(fts.search(commits.where("message is not null"), "commit_hash", "message", query, 2 * limit, "any"), "score", "commit_hash", "lex_rank")
    near = vector.knn_arrow(vectors.join(commits.select("commit_hash"), "commit_hash", "left_semi"), "commit_hash", "vector", query_vector, 2 * limit)
    top = fusion.rrf(lex, near, "commit_hash").orderBy(F.desc("score"), "commit_hash").limit(limit)
    top = cut(top.join(commits.select("commit_hash", "author", "timestamp", "message"), "commit_hash"))  # `limit` rows
    w = Window.partitionBy("commit_hash").orderBy("file_path", "id")
    few = diffs.join(F.broadcast(top.select("commit_hash")), "commit_hash", "left_semi").distinct().withColumn("__r", F.row_number().over(w)).where("__r <= 5")
    few = few.groupBy("commit_hash").agg(F.array_sort(F.collect_list(F.struct("file_path", "change_type", F.substring("diff_content", 1, 500).alias("preview")))).alias("diffs"))
    said = tags.groupBy("commit_hash").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return top.join(few, "commit_hash", "left").join(said, "commit_hash", "left")
