"""Queries over git history, the code graph, stack traces and rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.glob import rule_regex
from ..operators import graph
from ..operators import history as H
from ..session import table
from ..sources.files import capped
from . import base as B
from .base import query
from .index import search
from .text import match_sql

_NOISE = f"length(trim(lower(message))) >= 10 AND NOT regexp_matches(trim(lower(message)), '{T.NOISE}')"


@query("meaningful_commits", f"SELECT commit_hash, message FROM cm WHERE message IS NOT NULL AND {_NOISE}")
def meaningful_commits(spark, d):
    return B.commits(spark, d).where(T.is_meaningful(F.col("message"))).select("commit_hash", "message")


_TAGS = " UNION ALL ".join(f"SELECT commit_hash, '{tag}' AS tag FROM cm WHERE regexp_matches(lower(message), '\\b({words})\\b')" for tag, words in T.TAGS.items())


def _tags(spark, d):
    return B.commits(spark, d).where("message is not null").select("commit_hash", F.explode(T.commit_tags(F.col("message"))).alias("tag"))


@query("commit_tags", _TAGS)
def commit_tags(spark, d):
    return _tags(spark, d)


@query("commit_tags_lookup", f"WITH t AS ({_TAGS}) SELECT cm.commit_hash, coalesce(string_agg(tag, ',' ORDER BY tag), '') AS tags FROM cm LEFT JOIN t ON t.commit_hash = cm.commit_hash GROUP BY 1")
def commit_tags_lookup(spark, d):
    rows = B.commits(spark, d).select("commit_hash").join(_tags(spark, d), "commit_hash", "left")
    return rows.groupBy("commit_hash").agg(F.array_join(F.sort_array(F.collect_list("tag")), ",").alias("tags"))


@query("commit_diffs", "SELECT cm.commit_hash, gd.file_path, coalesce(gd.change_type, '') AS change_type, coalesce(length(gd.diff_content), 0) AS n_chars FROM cm JOIN gd ON gd.commit_hash = cm.commit_hash")
def commit_diffs(spark, d):
    rows = B.commits(spark, d).select("commit_hash").join(B.diffs(spark, d), "commit_hash")
    return rows.select("commit_hash", "file_path", F.coalesce("change_type", F.lit("")).alias("change_type"), F.coalesce(F.length("diff_content"), F.lit(0)).cast("long").alias("n_chars"))


@query("recent_commits", "SELECT project_id, commit_hash, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY timestamp DESC NULLS LAST, commit_hash) AS r FROM cm) WHERE r <= 100")
def recent_commits(spark, d):
    w = Window.partitionBy("project_id").orderBy(F.desc_nulls_last("timestamp"), "commit_hash")
    return B.commits(spark, d).select("project_id", "commit_hash", "timestamp").withColumn("r", F.row_number().over(w)).where("r <= 100").drop("r")


@query("count_commits", "SELECT project_id, count(*) AS n FROM cm GROUP BY 1")
def count_commits(spark, d):
    return B.commits(spark, d).groupBy("project_id").agg(F.count("*").alias("n"))


@query("backfill_project_id", "SELECT gd.id, coalesce(gd.project_id, p.project_id) AS project_id FROM gd LEFT JOIN (SELECT commit_hash, max(project_id) AS project_id FROM cm GROUP BY 1) p ON p.commit_hash = gd.commit_hash")
def backfill_project_id(spark, d):
    own = B.commits(spark, d).groupBy("commit_hash").agg(F.max("project_id").alias("found"))
    return B.diffs(spark, d).select("id", "commit_hash", "project_id").join(own, "commit_hash", "left").select("id", F.coalesce("project_id", "found").alias("project_id"))


_MESSAGES = "(SELECT commit_hash, message FROM cm WHERE message IS NOT NULL)"


@query("commit_search_bm25", match_sql(_MESSAGES, "commit_hash", "message", ["fix", "cache"], "f0 > 0 OR f1 > 0", 50))
def commit_search_bm25(spark, d):
    return search(spark, d, "messages", "fix cache", "any", 50)


@query("commit_search_like", "SELECT commit_hash, message FROM cm WHERE message ILIKE '%fix%' ORDER BY timestamp DESC NULLS LAST, commit_hash LIMIT 50")
def commit_search_like(spark, d):
    return B.commits(spark, d).where(F.col("message").ilike("%fix%")).orderBy(F.desc_nulls_last("timestamp"), "commit_hash").limit(50).select("commit_hash", "message")


_HISTORY = f"""WITH x AS (SELECT * FROM gd WHERE contains(file_path, 'src')), cc AS (SELECT * FROM cm WHERE commit_hash IN (SELECT commit_hash FROM x)),
lx AS (SELECT commit_hash, row_number() OVER (ORDER BY score, commit_hash) AS lex_rank FROM ({match_sql("(SELECT commit_hash, message FROM cc WHERE message IS NOT NULL)", "commit_hash", "message", ["fix", "cache"], "f0 > 0 OR f1 > 0", 20)})),
vx AS (SELECT commit_hash, row_number() OVER (ORDER BY s DESC, commit_hash) AS vec_rank FROM (SELECT commit_hash, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])), 6) AS s FROM cc JOIN embeddings e ON e.vec_id = cc.timestamp % (SELECT count(*) FROM embeddings) ORDER BY s DESC, commit_hash LIMIT 20)),
fu AS (SELECT coalesce(lx.commit_hash, vx.commit_hash) AS commit_hash, lex_rank, vec_rank, round(coalesce(1.0 / (60 + lex_rank), 0) + coalesce(1.0 / (60 + vec_rank), 0), 6) AS score FROM lx FULL JOIN vx ON lx.commit_hash = vx.commit_hash ORDER BY score DESC, 1 LIMIT 10),
fd AS (SELECT commit_hash, string_agg(concat(file_path, '>', coalesce(substr(diff_content, 1, 500), '')), '|' ORDER BY file_path, change_type NULLS FIRST) AS previews FROM (SELECT *, row_number() OVER (PARTITION BY commit_hash ORDER BY file_path, id) AS r FROM x) WHERE r <= 5 GROUP BY 1),
tg AS (SELECT commit_hash, string_agg(tag, ',' ORDER BY tag) AS tags FROM ({_TAGS}) GROUP BY 1)
SELECT fu.commit_hash, fu.score, coalesce(lex_rank, 0) AS lex_rank, coalesce(vec_rank, 0) AS vec_rank, coalesce(cc.message, '') AS message, coalesce(previews, '') AS previews, coalesce(tags, '') AS tags FROM fu JOIN cc ON cc.commit_hash = fu.commit_hash LEFT JOIN fd ON fd.commit_hash = fu.commit_hash LEFT JOIN tg ON tg.commit_hash = fu.commit_hash"""


@query("search_history", _HISTORY)
def search_history(spark, d):
    """The ten best commits by message and vector that touch a path with src in it, with their first diffs and their tags."""
    asked = list(table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"])
    rows = H.search(spark, B.commits(spark, d), B.repeated_diffs(spark, d), _tags(spark, d), B.commit_vectors(spark, d), "fix cache", asked, "src", 10)
    none = F.array().cast("array<string>")
    said = F.transform("diffs", lambda x: F.concat(x["file_path"], F.lit(">"), F.coalesce(x["preview"], F.lit(""))))
    rank = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("commit_hash", "score", rank("lex_rank"), rank("vec_rank"), F.coalesce("message", F.lit("")).alias("message"), F.array_join(F.coalesce(said, none), "|").alias("previews"), F.array_join(F.coalesce("tags", none), ",").alias("tags"))


_BARE = "replace(replace(replace({}, '\\\\', '\\'), '\\\"', '\"'), '\\t', chr(9))"


def _path_sql(block: str) -> str:
    head = f"array_to_string((string_split({block}, chr(10)))[1:15], chr(10))"
    get = lambda p: f"nullif(regexp_extract({head}, '{p}', 1), '')"
    quoted = lambda mark: "nullif(" + _BARE.format(f"regexp_replace(regexp_extract({head}, '(?:^|\\n){mark}([^\\n]*?)\\t?(?:\\n|$)', 1), '\"$', '')") + ", '')"
    parts = [get(r"(?:^|\n)\+\+\+ b/([^\n]*?)\t?(?:\n|$)"), quoted(r'\+\+\+ "b/'), get(r"(?:^|\n)Binary files? a/[^\n]+ and b/([^\n]+) differ(?:\n|$)"), get(r"(?:^|\n)--- a/([^\n]*?)\t?(?:\n|$)"), quoted(r'--- "a/')]
    return f"coalesce({', '.join(parts)})"


_PATH = _path_sql("diff_content")
_SECTION = """sec AS (SELECT concat_ws('|', cm.commit_hash, author, CAST(timestamp AS VARCHAR), message) AS head, concat(string_agg(concat(CASE change_type WHEN 'ADDED' THEN 'A' WHEN 'DELETED' THEN 'D' ELSE 'M' END, chr(9), file_path), chr(10) ORDER BY id), chr(10), string_agg(coalesce(diff_content, ''), chr(10) ORDER BY id)) AS rest
  FROM cm JOIN gd ON gd.commit_hash = cm.commit_hash WHERE message IS NOT NULL AND author IS NOT NULL AND file_path IS NOT NULL GROUP BY 1),
tx AS (SELECT split_part(concat(head, chr(10), rest), chr(10), 1) AS line, concat(head, chr(10), rest) AS s FROM sec),
ps AS (SELECT h[1] AS commit_hash, h[2] AS author, CAST(h[3] AS BIGINT) AS timestamp, trim(array_to_string(h[4:], '|')) AS message, substr(s, length(line) + 2) AS body FROM (SELECT *, string_split(line, '|') AS h FROM tx) WHERE len(h) >= 4 AND regexp_matches(h[3], '^[0-9]+$'))"""


# Log parsing. Sections are put together from the tables, with all their diffs, and taken apart again.
def _sections(spark, d):
    c = B.commits(spark, d).where("message is not null and author is not null").select("commit_hash", F.concat_ws("|", "commit_hash", "author", F.col("timestamp").cast("string"), "message").alias("head"))
    x = B.diffs(spark, d).where("file_path is not null")
    letter = F.when(F.col("change_type") == "ADDED", "A").when(F.col("change_type") == "DELETED", "D").otherwise("M")
    x = x.groupBy("commit_hash").agg(F.sort_array(F.collect_list(F.struct("id", F.concat(letter, F.lit("\t"), "file_path").alias("status"), F.coalesce("diff_content", F.lit("")).alias("diff_content")))).alias("x"))
    rows = c.join(x, "commit_hash")
    return rows.select(F.concat(F.lit(H.MARKER), "head", F.lit("\n"), F.array_join(F.transform("x", lambda y: y["status"]), "\n"), F.lit("\n"), F.array_join(F.transform("x", lambda y: y["diff_content"]), "\n")).alias("section"))


@query("git_parse_sections", f"WITH {_SECTION} SELECT commit_hash, author, timestamp, message, length(body) AS n_chars FROM ps")
def git_parse_sections(spark, d):
    """Of every commit; sections above the cap come without the lines beyond it, none of these is that long."""
    return H.parse_sections(capped(_sections(spark, d)), "section").select("commit_hash", "author", "timestamp", "message", F.length("body").cast("long").alias("n_chars"))


@query("git_parse_diffs", f"""WITH {_SECTION}, bl AS (SELECT commit_hash, string_split(concat(chr(10), body), concat(chr(10), 'diff --git ')) AS b FROM ps),
st AS (SELECT commit_hash, list_filter(string_split(b[1], chr(10)), lambda x: contains(x, chr(9))) AS st, unnest(b[2:]) AS rest FROM bl), dk AS (SELECT commit_hash, st, concat('diff --git ', rest) AS diff FROM st),
pt AS (SELECT *, {_path_sql("diff")} AS file_path FROM dk)
SELECT commit_hash, file_path, CASE substr(trim(list_filter(st, lambda x: (string_split(x, chr(9)))[-1] = file_path)[-1]), 1, 1) WHEN 'A' THEN 'ADDED' WHEN 'D' THEN 'DELETED' ELSE 'MODIFIED' END AS change_type, CASE WHEN length(diff) > 2000 THEN concat(substr(diff, 1, 2000), chr(10), '... (truncated)') ELSE diff END AS diff_content FROM pt WHERE file_path IS NOT NULL""")
def git_parse_diffs(spark, d):
    return H.parse_diffs(H.parse_sections(capped(_sections(spark, d)), "section"))


@query("git_diff_path", f"SELECT id, {_PATH} AS found FROM gd WHERE diff_content IS NOT NULL")
def git_diff_path(spark, d):
    return B.diffs(spark, d).where("diff_content is not null").select("id", H.diff_path(F.col("diff_content")).alias("found"))


# Co-change.
_LAST = "la AS (SELECT project_id, commit_hash, timestamp, message FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY timestamp DESC, commit_hash) AS r FROM cm WHERE project_id IS NOT NULL) WHERE r <= 2000)"
_PAIRS = f"{_LAST}, x AS (SELECT DISTINCT la.project_id, gd.commit_hash, file_path FROM gd JOIN la ON la.commit_hash = gd.commit_hash WHERE file_path IS NOT NULL), pa AS (SELECT a.project_id, a.file_path AS file_a, b.file_path AS file_b, count(*) AS frequency FROM x a JOIN x b ON a.project_id = b.project_id AND a.commit_hash = b.commit_hash AND a.file_path < b.file_path GROUP BY 1, 2, 3 HAVING count(*) >= 3)"
_RECENT = f"{_PAIRS}, y AS (SELECT DISTINCT commit_hash, file_path FROM gd WHERE file_path IS NOT NULL), rc AS (SELECT * FROM (SELECT pa.project_id, file_a, file_b, cm.commit_hash, cm.message, row_number() OVER (PARTITION BY pa.project_id, file_a, file_b ORDER BY cm.timestamp DESC, cm.commit_hash) AS rn FROM pa JOIN y a ON a.file_path = file_a JOIN y b ON b.file_path = file_b AND b.commit_hash = a.commit_hash JOIN cm ON cm.commit_hash = a.commit_hash AND cm.project_id = pa.project_id) WHERE rn <= 3)"


def _pairs(spark, d):
    return H.couplings(B.repeated_diffs(spark, d), B.commits(spark, d), 3, 2000)


@query("temporal_couplings", f"WITH {_PAIRS} SELECT * FROM pa")
def temporal_couplings(spark, d):
    return _pairs(spark, d)


@query("coupling_recent_commits", f"WITH {_RECENT} SELECT * FROM rc")
def coupling_recent_commits(spark, d):
    return H.coupling_commits(_pairs(spark, d), B.diffs(spark, d), B.commits(spark, d)).withColumn("rn", F.col("rn").cast("long"))


@query("coupling_common_tags", f"WITH {_RECENT}, t AS ({_TAGS}) SELECT project_id, file_a, file_b, tag, n FROM (SELECT project_id, file_a, file_b, tag, count(*) AS n, row_number() OVER (PARTITION BY project_id, file_a, file_b ORDER BY count(*) DESC, tag) AS r FROM rc JOIN t ON t.commit_hash = rc.commit_hash GROUP BY 1, 2, 3, 4) WHERE r <= 3")
def coupling_common_tags(spark, d):
    rows = H.coupling_commits(_pairs(spark, d), B.diffs(spark, d), B.commits(spark, d)).join(_tags(spark, d), "commit_hash")
    counts = rows.groupBy("project_id", "file_a", "file_b", "tag").agg(F.count("*").alias("n"))
    w = Window.partitionBy("project_id", "file_a", "file_b").orderBy(F.desc("n"), "tag")
    return counts.withColumn("r", F.row_number().over(w)).where("r <= 3").drop("r")


@query("file_style_diffs", "SELECT * FROM (SELECT cm.project_id, gd.file_path, gd.commit_hash, row_number() OVER (PARTITION BY cm.project_id, gd.file_path ORDER BY cm.timestamp DESC, gd.commit_hash, gd.id) AS rn FROM gd JOIN cm ON cm.commit_hash = gd.commit_hash WHERE gd.diff_content <> '') WHERE rn <= 10")
def file_style_diffs(spark, d):
    """The newest ten diffs of every file."""
    rows = B.diffs(spark, d).where("diff_content <> ''").select("commit_hash", "id", "file_path").join(B.commits(spark, d).select("commit_hash", "project_id", "timestamp"), "commit_hash")
    w = Window.partitionBy("project_id", "file_path").orderBy(F.desc("timestamp"), "commit_hash", "id")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn <= 10").select("project_id", "file_path", "commit_hash", F.col("rn").cast("long").alias("rn"))


_STYLE = "concat('Commit: ', substr(commit_hash, 1, 8), chr(10), 'Message: ', coalesce(message, ''), chr(10), 'Diff:', chr(10), substr(diff_content, 1, 2000), CASE WHEN length(diff_content) > 2000 THEN chr(10) || '... (truncated)' ELSE '' END)"


@query("style_prompt", f"SELECT project_id, file_path, count(*) AS n_commits, concat('Recent changes to ', file_path, ':', chr(10), string_agg({_STYLE}, chr(10) ORDER BY rn)) AS prompt FROM (SELECT cm.project_id, gd.file_path, gd.commit_hash, gd.diff_content, cm.message, row_number() OVER (PARTITION BY cm.project_id, gd.file_path ORDER BY cm.timestamp DESC, gd.commit_hash, gd.id) AS rn FROM gd JOIN cm ON cm.commit_hash = gd.commit_hash WHERE gd.diff_content <> '') WHERE rn <= 3 GROUP BY 1, 2")
def style_prompt(spark, d):
    rows = B.diffs(spark, d).where("diff_content <> ''").select("commit_hash", "id", "file_path", "diff_content").join(B.commits(spark, d).select("commit_hash", "project_id", "timestamp", "message"), "commit_hash")
    w = Window.partitionBy("project_id", "file_path").orderBy(F.desc("timestamp"), "commit_hash", "id")
    said = F.concat(F.lit("Commit: "), F.substring("commit_hash", 1, 8), F.lit("\nMessage: "), F.coalesce("message", F.lit("")), F.lit("\nDiff:\n"), F.substring("diff_content", 1, 2000), F.when(F.length("diff_content") > 2000, "\n... (truncated)").otherwise(""))
    top = rows.withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("project_id", "file_path", F.struct("rn", said.alias("said")).alias("x"))
    out = top.groupBy("project_id", "file_path").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return out.select("project_id", "file_path", F.size("xs").cast("long").alias("n_commits"), F.concat(F.lit("Recent changes to "), "file_path", F.lit(":\n"), F.array_join(F.transform("xs", lambda x: x["said"]), "\n")).alias("prompt"))


# Reverts.
_REV = """rv AS (SELECT *, nullif(regexp_extract(txt, '([a-f0-9]{7,40})', 1), '') AS digest FROM (SELECT project_id, commit_hash, timestamp, message, coalesce(nullif(regexp_extract(lower(trim(message)), '^revert[:\\s]+["'']?(.+?)["'']?$', 1), ''), nullif(regexp_extract(lower(trim(message)), 'this reverts commit\\s+([a-f0-9]{7,40})', 1), '')) AS txt FROM cm) WHERE txt IS NOT NULL)"""
_RP = f"""{_REV}, nw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY timestamp DESC NULLS LAST, commit_hash) AS pos FROM cm WHERE project_id IS NOT NULL) WHERE pos <= 1000 AND message IS NOT NULL AND timestamp IS NOT NULL),
ol AS (SELECT project_id, commit_hash AS original_hash, timestamp AS was, lower(message) AS subject FROM nw),
rp AS (SELECT project_id, revert_hash, arg_max(original_hash, (was, reverse_key)) AS original_hash FROM (SELECT rv.project_id, rv.commit_hash AS revert_hash, original_hash, was, -CAST(row_number() OVER (ORDER BY original_hash) AS BIGINT) AS reverse_key FROM rv JOIN ol ON ol.project_id = rv.project_id AND ol.was < rv.timestamp AND ol.original_hash <> rv.commit_hash AND (CASE WHEN digest IS NOT NULL THEN starts_with(original_hash, digest) ELSE contains(subject, txt) END) WHERE rv.commit_hash IN (SELECT commit_hash FROM nw)) GROUP BY 1, 2)"""


@query("detect_reverts", f"WITH {_REV} SELECT commit_hash, txt AS said, coalesce(digest, '') AS digest FROM rv")
def detect_reverts(spark, d):
    rows = B.commits(spark, d).withColumn("r", H.detect_reverts(F.col("message"))).where("r is not null")
    return rows.select("commit_hash", F.col("r.text").alias("said"), F.coalesce("r.hash", F.lit("")).alias("digest"))


@query("revert_pairs", f"WITH {_RP} SELECT * FROM rp")
def revert_pairs(spark, d):
    return H.revert_pairs(B.commits(spark, d))


_RULE_SQL = (
    "concat('CRITICAL: Anti-pattern detected from reverted commit ', substr(original_hash, 1, 8), '.', chr(10), chr(10), 'Original commit: ', chr(39), b.message, chr(39), chr(10), "
    "'This commit was REVERTED because it caused a regression.', chr(10), chr(10), 'Affected files: ', array_to_string(f[1:3], ', '), chr(10), CASE WHEN len(f) > 3 THEN '...' ELSE '' END, chr(10), chr(10), "
    "'Before making similar changes, review why this was reverted:', chr(10), 'Revert message: ', chr(39), u.message, chr(39), chr(10), chr(10), 'Recommendation: Search git history for this commit to understand the failure.')"
)
_RULES_SQL = f"""WITH {_RP}, fl AS (SELECT commit_hash, list_sort(list(DISTINCT file_path)) AS f FROM gd WHERE file_path IS NOT NULL GROUP BY 1)
SELECT concat('immune_system_', substr(original_hash, 1, 12)) AS rule_id, rp.project_id, array_to_string(f[1:5], '|') AS file_pattern, CAST(10 AS INTEGER) AS priority, min({_RULE_SQL}) AS rule_text
FROM rp JOIN fl ON fl.commit_hash = original_hash JOIN cm b ON b.commit_hash = original_hash JOIN cm u ON u.commit_hash = revert_hash GROUP BY 1, 2, 3, 4"""


@query("revert_rules", _RULES_SQL)
def revert_rules(spark, d):
    c = B.commits(spark, d)
    return H.revert_rules(H.revert_pairs(c), c, B.diffs(spark, d))


# The code graph.
@query("query_graph_nodes", "SELECT node_id, name, file_path, start_line FROM nodes WHERE node_type = 'function' AND name ILIKE '%e%' ORDER BY file_path, start_line, node_id LIMIT 100")
def query_graph_nodes(spark, d):
    return graph.query_nodes(B.nodes(spark, d), "function", "%e%").select("node_id", "name", "file_path", "start_line")


_SYMBOL = "Supplier#00000000"


@query("find_symbol_definitions", f"SELECT node_id, name FROM nodes WHERE name = '{_SYMBOL}' OR name ILIKE '%{_SYMBOL}%' ORDER BY CASE WHEN name <> '{_SYMBOL}' THEN 1 ELSE 0 END, name, node_id LIMIT 50")
def find_symbol_definitions(spark, d):
    return graph.definitions(B.nodes(spark, d), _SYMBOL).select("node_id", "name")


@query("find_symbol_references", "SELECT target_id, source_id, name, file_path FROM (SELECT DISTINCT e.target_id, e.source_id, n.name, n.file_path, dense_rank() OVER (PARTITION BY e.target_id ORDER BY e.source_id, n.file_path) AS r FROM edges e JOIN nodes n ON n.node_id = e.source_id JOIN nodes t ON t.node_id = e.target_id) WHERE r <= 100")
def find_symbol_references(spark, d):
    n = B.nodes(spark, d)
    return graph.references(n, B.edges(spark, d), n)


@query("find_references", "SELECT node_id, direction, peer_id, edge_type, n.name AS peer_name FROM (SELECT source_id AS node_id, 'outgoing' AS direction, target_id AS peer_id, edge_type FROM edges UNION ALL SELECT target_id, 'incoming', source_id, edge_type FROM edges) e LEFT JOIN (SELECT node_id AS nid, name FROM nodes) n ON n.nid = e.peer_id WHERE node_id IN (SELECT node_id FROM nodes WHERE node_type = 'class')")
def find_references(spark, d):
    n = B.nodes(spark, d)
    return graph.neighbours(B.edges(spark, d), n, n.where("node_type = 'class'"))


_ASK = "where does Cache hold the stream_reader of a page"
_STEM = "regexp_extract(file_path, '([^/\\\\]+?)(?:\\.[^./\\\\]+)?$', 1)"
_FILES = "fn AS (SELECT DISTINCT file_path AS node_id, " + _STEM + " AS name, file_path FROM fm WHERE NOT starts_with(file_path, 'vfs://'))"


@query("graph_search", f"""WITH h AS ({match_sql("c", "chunk_id", "content", ["where", "does", "cache", "hold", "the", "stream reader", "of", "a", "page"], " OR ".join(f"f{i} > 0" for i in range(9)), 150)}),
{_FILES}, sy AS (SELECT DISTINCT s FROM (SELECT unnest(regexp_extract_all('{_ASK}', '([A-Za-z_][A-Za-z0-9_]*)', 1)) AS s) WHERE length(s) >= 4 OR contains(s, '_') OR regexp_matches(s, '^[A-Z].') OR regexp_matches(s, '^.+[A-Z]')),
hf AS (SELECT DISTINCT file_path FROM (SELECT file_path, row_number() OVER (PARTITION BY s ORDER BY file_path, node_id) AS r FROM fn JOIN sy ON contains(lower(name), lower(s))) WHERE r <= 50),
it AS (SELECT chunk_id, json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.item_name') AS item FROM c)
SELECT h.chunk_id, hf.file_path IS NOT NULL AS graph_match, round(-h.score + CASE WHEN hf.file_path IS NOT NULL THEN 0.03 ELSE 0 END, 6) AS score FROM h JOIN it ON it.chunk_id = h.chunk_id LEFT JOIN hf ON hf.file_path = it.item ORDER BY score DESC, chunk_id LIMIT 50""")
def graph_search(spark, d):
    """A search in which chunks of files that a symbol of the query names are lifted; nodes are the files by their names."""
    stem = F.regexp_extract("file_path", r"([^/\\]+?)(?:\.[^./\\]+)?$", 1)
    nodes = B.files(spark, d).where(~F.col("file_path").startswith("vfs://")).select(F.col("file_path").alias("node_id"), stem.alias("name"), "file_path", F.lit(1).alias("start_line")).distinct()
    files = graph.symbol_files(spark.createDataFrame([(0, _ASK)], "id int, q string"), "id", "q", nodes)
    item = F.get_json_object("metadata", "$.item_name")
    hits = search(spark, d, "chunks", _ASK, "any", 150).join(B.chunks(spark, d).select("chunk_id", item.alias("file_path")), "chunk_id")
    return graph.lifted(hits, files).select("chunk_id", "graph_match", "score").orderBy(F.desc("score"), "chunk_id").limit(50)


# Stack traces stand in the error reports.
_ZIP = "SELECT doc_id, {k} AS kind, unnest(regexp_extract_all(text, '{p}', 1)) AS file, unnest(regexp_extract_all(text, '{p}', 2)) AS line FROM documents WHERE text IS NOT NULL"
_FRAMES = "fr AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY kind, seq) - 1 AS BIGINT) AS pos, file, CAST(line AS INTEGER) AS line, CASE kind WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' ELSE 'rust_or_go' END AS language FROM (SELECT *, row_number() OVER () AS seq FROM ({}) ) WHERE kind = 0 OR kind = 1 AND NOT contains(file, 'node_modules') AND NOT starts_with(file, 'internal/') OR kind = 2 AND regexp_matches(file, '\\.(rs|go)$'))".format(" UNION ALL ".join(_ZIP.format(k=k, p=p) for k, p in ((0, graph.PYTHON_FRAME), (1, graph.SCRIPT_FRAME), (2, graph.SCRIPT_FRAME))))


@query("parse_stack_trace", f"WITH {_FRAMES} SELECT * FROM fr")
def parse_stack_trace(spark, d):
    return graph.frames(table(spark, d, "documents"), "doc_id", "text").withColumn("pos", F.col("pos").cast("long"))


_SPANS = "sp AS (SELECT DISTINCT fc.file_path AS span_file, c.chunk_id, c.internal_id, CAST(json_extract_string(CASE WHEN json_valid(c.metadata) THEN c.metadata END, '$.chunk_index') AS BIGINT) * 40 + 1 AS start_line, CAST(json_extract_string(CASE WHEN json_valid(c.metadata) THEN c.metadata END, '$.chunk_index') AS BIGINT) * 40 + 60 AS end_line FROM fc JOIN c ON c.chunk_id = fc.chunk_id)"


def _spans(spark, d):
    """Chunks of files with about the lines they hold."""
    at = F.get_json_object("metadata", "$.chunk_index").cast("long") * 40
    c = B.chunks(spark, d).select("chunk_id", "internal_id", (at + 1).alias("start_line"), (at + 60).alias("end_line"))
    return B.links(spark, d).select("chunk_id", F.col("file_path").alias("file")).join(c, "chunk_id").distinct()


@query("chunks_by_line_range", f"WITH {_SPANS} SELECT span_file, chunk_id, internal_id FROM sp WHERE coalesce(start_line, 0) <= 80 AND coalesce(end_line, 999999) >= 41")
def chunks_by_line_range(spark, d):
    rows = _spans(spark, d).where((F.coalesce("start_line", F.lit(0)) <= 80) & (F.coalesce("end_line", F.lit(999_999)) >= 41))
    return rows.select(F.col("file").alias("span_file"), "chunk_id", "internal_id")


@query("analyze_error_stack", f"""WITH {_SPANS}, f AS (SELECT DISTINCT commit_hash, file_path AS file, CAST(1 + length(coalesce(diff_content, '')) % 200 AS INTEGER) AS line FROM gd WHERE file_path IS NOT NULL AND NOT contains(file_path, '"') AND NOT contains(file_path, chr(10)))
SELECT f.commit_hash, f.file, line, 'python' AS language, arg_min(sp.chunk_id, (sp.internal_id, sp.chunk_id)) AS chunk_id FROM f LEFT JOIN sp ON sp.span_file = f.file AND coalesce(start_line, 0) <= line + 5 AND coalesce(end_line, 999999) >= line - 5 GROUP BY 1, 2, 3, 4""")
def analyze_error_stack(spark, d):
    """A trace for each commit, with a frame for every changed file, is parsed and its frames resolved to chunks."""
    x = B.diffs(spark, d).where(F.col("file_path").isNotNull() & ~F.col("file_path").contains('"') & ~F.col("file_path").contains("\n"))
    said = F.concat(F.lit('  File "/repo/'), "file_path", F.lit('", line '), (1 + F.length(F.coalesce("diff_content", F.lit(""))) % 200).cast("string"), F.lit(", in f"))
    traces = x.select("commit_hash", said.alias("said")).distinct().groupBy("commit_hash").agg(F.concat(F.lit("Traceback (most recent call last):\n"), F.array_join(F.sort_array(F.collect_list("said")), "\n")).alias("trace"))
    found = graph.frames(traces, "commit_hash", "trace").select("commit_hash", F.regexp_replace("file", "^/repo/", "").alias("file"), "line", "language")
    return graph.frame_context(found, _spans(spark, d), ["commit_hash"])


# Rules.
_RULES = [("*.py", "keep functions small", 10), ("src/**/*.ts", "no default exports", 5), ("README.md|CHANGELOG.md", "write for readers", 1)]


@query("repo_rules", f"SELECT rule_id, project_id, file_pattern, priority FROM ({_RULES_SQL}) ORDER BY priority DESC, rule_id")
def repo_rules(spark, d):
    """The rules drawn from reverts, the most important first."""
    return revert_rules(spark, d).select("rule_id", "project_id", "file_pattern", "priority").orderBy(F.desc("priority"), "rule_id")


_HEADER = ", ".join(f"CASE WHEN regexp_matches(file_path, '{rule_regex(p)}') THEN '[Repo Constraint]: {t}' || chr(10) ELSE '' END" for p, t, _ in _RULES)


@query("rule_injection", f"SELECT chunk_id, file_path, CASE WHEN head = '' THEN content ELSE concat(head, chr(10), content) END AS content FROM (SELECT c.chunk_id, file_path, content, concat({_HEADER}) AS head FROM c JOIN fc ON fc.chunk_id = c.chunk_id WHERE content IS NOT NULL)")
def rule_injection(spark, d):
    rows = B.chunks(spark, d).where("content is not null").select("chunk_id", "content").join(B.links(spark, d), "chunk_id").select("chunk_id", "file_path", "content")
    return graph.inject_rules(rows, _RULES, "file_path", "content")


@query("extract_python_symbols")
def extract_python_symbols(spark, d):
    rows = B.links(spark, d).where(F.col("file_path").endswith(".py")).join(B.chunks(spark, d).select("chunk_id", "content"), "chunk_id")
    return graph.extract_symbols(rows, "file_path", "content", ["project_id", "chunk_id"], graph.python_symbols)


@query("extract_polyglot_symbols")
def extract_polyglot_symbols(spark, d):
    rows = B.links(spark, d).where(~F.col("file_path").endswith(".py")).join(B.chunks(spark, d).select("chunk_id", "content"), "chunk_id")
    return graph.extract_symbols(rows, "file_path", "content", ["project_id", "chunk_id"])
