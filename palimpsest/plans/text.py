"""Queries over text: tokens, windows, ids, and full-text search."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.glob import IGNORED, TEXT_EXTENSIONS, extension, is_ignored, regexes
from ..operators import fts
from ..session import shared_dir, table
from ..sources import files as sources
from . import base as B
from .base import query
from .index import search

S, W = r"[^ \t\n\r\f\x0B]", r"[ \t\n\r\f\x0B]"
TOKENS = f"list_filter(string_split_regex(translate(lower(%s), '{T.ACCENTED}', '{T.PLAIN}'), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
PIECES = f"regexp_extract_all(text, '({S}+{W}*)', 1)"


def _docs(spark, d):
    return table(spark, d, "documents")


@query("token_count", f"SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '{S}+')), 0) AS BIGINT) AS n_tokens FROM documents")
def token_count(spark, d):
    return _docs(spark, d).select("doc_id", F.coalesce(T.token_count(F.col("text")), F.lit(0)).cast("long").alias("n_tokens"))


@query("tokenize", f"SELECT doc_id, coalesce(array_to_string({TOKENS % 'text'}, ' '), '') AS toks FROM documents")
def tokenize(spark, d):
    return _docs(spark, d).select("doc_id", F.coalesce(F.array_join(T.tokens(F.col("text")), " "), F.lit("")).alias("toks"))


_WINDOWS = f"""WITH p AS (SELECT doc_id, {PIECES} AS p FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, p, unnest(range(0, greatest(len(p) - 30 - 1, 0) + 1, 170)) AS s FROM p WHERE len(p) > 0),
w AS (SELECT doc_id, CAST(s / 170 AS BIGINT) AS chunk_index, s AS first_token, least(s + 200, len(p)) - 1 AS last_token, regexp_replace(array_to_string(p[s + 1:s + 200], ''), '{W}+$', '') AS content FROM s)
"""


def _windows(spark, d):
    w = T.windows(F.col("text"), 200, 30)
    rows = _docs(spark, d).select("doc_id", F.explode(w).alias("w"))
    return rows.select("doc_id", F.col("w.chunk_index").cast("long").alias("chunk_index"), F.col("w.first_token").cast("long").alias("first_token"), F.col("w.last_token").cast("long").alias("last_token"), F.col("w.content").alias("content"))


@query("chunk_text", _WINDOWS + "SELECT * FROM w")
def chunk_text(spark, d):
    return _windows(spark, d)


@query("chunk_ids", _WINDOWS + "SELECT doc_id, chunk_index, sha256(concat(sha256(concat('doc/', CAST(doc_id AS VARCHAR), chr(0))), chr(0), CAST(chunk_index AS VARCHAR), chr(0), content, chr(0))) AS chunk_id FROM w")
def chunk_ids(spark, d):
    root = T.make_id(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")))
    return _windows(spark, d).select("doc_id", "chunk_index", T.make_id(root, F.col("chunk_index"), F.col("content")).alias("chunk_id"))


@query("ingest_documents", _WINDOWS + f"""SELECT w.doc_id, chunk_index, concat(CAST(first_token AS VARCHAR), '-', CAST(last_token AS VARCHAR)) AS token_range, sha256(text) AS content_hash, CAST(len(regexp_extract_all(content, '{S}+')) AS BIGINT) AS n_tokens,
sha256(content) AS chunk_hash FROM w JOIN documents USING (doc_id)""")
def ingest_documents(spark, d):
    rows = _docs(spark, d).select("doc_id", F.sha2("text", 256).alias("content_hash"), F.explode(T.windows(F.col("text"), 200, 30)).alias("w"))
    return rows.select("doc_id", F.col("w.chunk_index").cast("long").alias("chunk_index"), F.concat_ws("-", F.col("w.first_token").cast("string"), F.col("w.last_token").cast("string")).alias("token_range"), "content_hash", T.token_count(F.col("w.content")).cast("long").alias("n_tokens"), F.sha2("w.content", 256).alias("chunk_hash"))


_LARGE = f"""WITH p AS (SELECT chunk_id, {PIECES.replace('text', 'content', 1)} AS p FROM c WHERE content IS NOT NULL),
s AS (SELECT chunk_id, p, unnest(range(0, greatest(len(p) - 40 - 1, 0) + 1, 360)) AS s FROM p WHERE len(p) > 0)
SELECT chunk_id, CAST(s / 360 AS BIGINT) AS chunk_index, s AS first_token, least(s + 400, len(p)) - 1 AS last_token, regexp_replace(array_to_string(p[s + 1:s + 400], ''), '{W}+$', '') AS content FROM s"""


@query("chunk_large", _LARGE)
def chunk_large(spark, d):
    """Windows at 400/40 of whole chunks of code, however large: the same expression has no size limit."""
    rows = B.chunks(spark, d).select("chunk_id", F.explode(T.windows(F.col("content"), 400, 40)).alias("w"))
    return rows.select("chunk_id", *[F.col(f"w.{c}").cast("long").alias(c) for c in ("chunk_index", "first_token", "last_token")], F.col("w.content").alias("content"))


@query("truncate_tokens", f"SELECT doc_id, CASE WHEN len({PIECES}) <= 50 THEN text ELSE regexp_replace(array_to_string(({PIECES})[1:50], ''), '{W}+$', '') END AS text_50 FROM documents WHERE text IS NOT NULL")
def truncate_tokens(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", T.truncate_tokens(F.col("text"), 50).alias("text_50"))


@query("trim_content", "SELECT chunk_id, CASE WHEN length(content) > 1200 THEN concat(substr(content, 1, 1200), '…') ELSE content END AS trimmed FROM c WHERE content IS NOT NULL")
def trim_content(spark, d):
    return B.chunks(spark, d).where("content is not null").select("chunk_id", T.trim_content(F.col("content"), 1200).alias("trimmed"))


@query("slug", "SELECT project_id, CASE WHEN s = '' THEN 'project' ELSE s END AS slug FROM (SELECT project_id, regexp_replace(regexp_replace(lower(trim(project_name)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM pr)")
def slug(spark, d):
    return B.projects(spark, d).select("project_id", T.slug(F.col("project_name")).alias("slug"))


@query("pick_model", "SELECT project_id, CASE WHEN contains(lower(coalesce(project_type, '')), 'code') THEN 'code' ELSE 'text' END AS model FROM pr")
def pick_model(spark, d):
    return B.projects(spark, d).select("project_id", F.when(F.lower(F.coalesce("project_type", F.lit(""))).contains("code"), "code").otherwise("text").alias("model"))


@query("valid_project_ids", f"SELECT project_id, regexp_matches(project_id, '{T.PROJECT_ID}') AND NOT regexp_matches(project_id, '{T.DEVICES}') AS valid FROM pr")
def valid_project_ids(spark, d):
    return B.projects(spark, d).select("project_id", T.valid_project_id(F.col("project_id")).alias("valid"))


@query("sanitize_section", "SELECT DISTINCT raw, regexp_replace(raw, '[^\\p{L}\\p{N}_\\-]', '', 'g') AS section FROM (SELECT concat('../', section, '/', coalesce(source, ''), '!') AS raw FROM documents WHERE section IS NOT NULL)")
def sanitize_section(spark, d):
    raw = F.concat(F.lit("../"), "section", F.lit("/"), F.coalesce("source", F.lit("")), F.lit("!")).alias("raw")
    return _docs(spark, d).where("section is not null").select(raw).distinct().select("raw", T.sanitize_section(F.col("raw")).alias("section"))


@query("symbol_candidates", """SELECT session_id, pos, sym FROM (SELECT session_id, unnest(x) AS sym, unnest(range(len(x))) AS pos FROM (SELECT session_id, list_filter(regexp_extract_all(query, '([A-Za-z_][A-Za-z0-9_]*)', 1),
 lambda t: length(t) >= 4 OR contains(t, '_') OR regexp_matches(t, '^[A-Z].') OR regexp_matches(t, '^.+[A-Z]')) AS x FROM ss WHERE query IS NOT NULL))""")
def symbol_candidates(spark, d):
    rows = B.sessions(spark, d).where("query is not null").select("session_id", F.posexplode(T.candidate_symbols(F.col("query"))).alias("pos", "sym"))
    return rows.select("session_id", F.col("pos").cast("long").alias("pos"), "sym")


@query("safe_metadata", """SELECT chunk_id, coalesce(json_extract_string(m, '$.type'), '') AS kind, coalesce(json_extract_string(m, '$.item_name'), '') AS item_name, coalesce(json_extract_string(m, '$.private'), 'false') AS private
FROM (SELECT chunk_id, CASE WHEN metadata IS NULL OR trim(metadata) = '' THEN '{}' WHEN NOT json_valid(metadata) OR json_type(CASE WHEN json_valid(metadata) THEN metadata END) <> 'OBJECT' THEN '{"_metadata_decode_error": true, "private": true}' ELSE metadata END AS m FROM c)""")
def safe_metadata(spark, d):
    m = T.safe_metadata(F.col("metadata"))
    get = lambda p, e: F.coalesce(F.get_json_object("m", p), F.lit(e))
    return B.chunks(spark, d).select("chunk_id", m.alias("m")).select("chunk_id", get("$.type", "").alias("kind"), get("$.item_name", "").alias("item_name"), get("$.private", "false").alias("private"))


# Files by name.
@query("scan_files", "SELECT project_id, file_path, coalesce(size_bytes, -1) AS size_bytes FROM fm WHERE NOT starts_with(file_path, 'vfs://')")
def scan_files(spark, d):
    return B.files(spark, d).where(~F.col("file_path").startswith("vfs://")).select("project_id", "file_path", F.coalesce("size_bytes", F.lit(-1)).alias("size_bytes"))


_WHOLE, _NAME = (r.replace("'", "''") for r in regexes(IGNORED))
_IGN = f"(regexp_matches(file_path, '{_WHOLE}') OR regexp_matches(regexp_extract(file_path, '([^/]*)$', 1), '{_NAME}'))"


@query("filter_ignored", f"SELECT project_id, file_path, {_IGN} AS ignored FROM fm")
def filter_ignored(spark, d):
    return B.files(spark, d).select("project_id", "file_path", is_ignored(F.col("file_path")).alias("ignored"))


@query("scan_filter_ignored", f"SELECT project_id, file_path FROM fm WHERE NOT starts_with(file_path, 'vfs://') AND NOT {_IGN}")
def scan_filter_ignored(spark, d):
    return scan_files(spark, d).where(~is_ignored(F.col("file_path"))).select("project_id", "file_path")


@query("scan_filter_supported", "SELECT project_id, file_path FROM fm WHERE NOT starts_with(file_path, 'vfs://') AND lower(regexp_extract(file_path, '(\\.[^./\\\\]+)$', 1)) IN (%s)" % ", ".join(f"'{e}'" for e in TEXT_EXTENSIONS))
def scan_filter_supported(spark, d):
    return scan_files(spark, d).where(extension(F.col("file_path")).isin(*TEXT_EXTENSIONS)).select("project_id", "file_path")


_TREE = "SELECT concat('.', project_id, '/_', chunk_id, '.py') AS rel_path, strlen(content) + 1 AS size_bytes, length(content) AS n_chars, sha256(content) AS text_hash FROM c WHERE project_id IS NOT NULL AND content IS NOT NULL"


@query("scan_tree", _TREE)
def scan_tree(spark, d):
    """Every chunk written as a file of a hidden folder, with a byte that is no UTF-8 behind it, then the tree scanned and read."""
    root = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    rows = B.chunks(spark, d).where("project_id is not null and content is not null").select(F.concat(F.lit("."), "project_id", F.lit("/_"), "chunk_id", F.lit(".py")).alias("rel_path"), F.concat(F.encode("content", "UTF-8"), F.lit(bytearray(b"\xff"))).alias("content"))
    sources.write_files(rows, root).count()
    found = sources.texts(sources.supported(sources.listing(spark, root)))
    return found.select("rel_path", "size_bytes", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_hash"))


@query("file_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL")
def file_hash(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"))


# Full-text search.
@query("fts_postings", f"""WITH t AS (SELECT doc_id, {TOKENS % 'text'} AS toks FROM documents), e AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term, unnest(range(len(toks))) AS pos FROM t)
SELECT term, doc_id, count(*) AS tf, max(dl) AS dl, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM e GROUP BY 1, 2""")
def fts_postings(spark, d):
    return fts.postings(_docs(spark, d), "doc_id", "text").select("term", "doc_id", "tf", "dl", F.array_join("positions", ",").alias("positions"))


def match_sql(source: str, key: str, text: str, phrases: list[str], where: str, limit: int | None = None, within: str = "true", scored: int | None = None) -> str:
    """The SQL of a search over whole texts, for given phrases of plain words; f0, f1, ... say how often each occurs.

    `where` says what matches; the first `scored` phrases count for the score. Nothing of it comes from the engine's query parser.
    """
    lit = lambda p: "'" + "".join(f" {w} " for w in p.split()) + "'"
    tf = ", ".join(f"(length(body) - length(replace(body, {lit(p)}, ''))) / {len(lit(p)) - 2}.0 AS f{i}" for i, p in enumerate(phrases))
    ns = ", ".join(f"sum(CASE WHEN f{i} > 0 THEN 1 ELSE 0 END) AS n{i}" for i in range(len(phrases)))
    idf = lambda i: f"(CASE WHEN ln((total - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((total - n{i} + 0.5) / (n{i} + 0.5)) END)"
    score = " + ".join(f"{idf(i)} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(scored or len(phrases)))
    end = f" ORDER BY score, {key} LIMIT {limit}" if limit else ""
    return f"""WITH tk AS (SELECT *, {TOKENS % f"coalesce({text}, '')"} AS toks FROM {source}), bd AS (SELECT *, len(toks) AS dl, concat(' ', array_to_string(toks, '  '), ' ') AS body FROM tk),
fr AS (SELECT *, {tf} FROM bd), st AS (SELECT count(*) AS total, avg(dl) AS avgdl, {ns} FROM fr)
SELECT {key}, round(-({score}), 6) AS score FROM fr, st WHERE ({where}) AND ({within}){end}"""


FIRST = "project_id = (SELECT min(project_id) FROM projects)"


def first_project(spark, d) -> str:
    return table(spark, d, "projects").agg(F.min("project_id")).first()[0]


@query("bm25_score", match_sql("documents", "doc_id", "text", ["reader", "cache", "the"], "f0 > 0 OR f1 > 0 OR f2 > 0"))
def bm25_score(spark, d):
    return search(spark, d, "documents", "reader OR cache OR the")


@query("fts_search_any", match_sql("c", "chunk_id", "content", ["stream", "cache", "the"], "f0 > 0 OR f1 > 0 OR f2 > 0", 200, FIRST))
def fts_search_any(spark, d):
    """The best 200 chunks of one project, by the statistics of all."""
    return search(spark, d, "chunks", "stream cache the", "any", 200, first_project(spark, d))


@query("fts_search_strict", match_sql("c", "chunk_id", "content", ["return", "vector"], "f0 > 0 AND f1 > 0", 200, FIRST))
def fts_search_strict(spark, d):
    return search(spark, d, "chunks", "return vector", "strict", 200, first_project(spark, d))


@query("fts_boolean", match_sql("c", "chunk_id", "content", ["import", "return", "vector", "class"], "f0 > 0 AND (f1 > 0 AND NOT f3 > 0) OR f2 > 0", scored=3))
def fts_boolean(spark, d):
    return search(spark, d, "chunks", "import and return not class or vector")


@query("fts_phrase", match_sql("documents", "doc_id", "text", ["the ranking step"], "f0 > 0"))
def fts_phrase(spark, d):
    return search(spark, d, "documents", "the ranking step", "phrase")


@query("fts_match_ids", match_sql("(SELECT chunk_id, concat_ws(' ', chunk_id, project_id, content) AS content FROM c)", "chunk_id", "content", ["stream", "kernel"], "f0 > 0 AND f1 > 0"))
def fts_match_ids(spark, d):
    """As a search whose index also holds the ids' own tokens."""
    return search(spark, d, "chunks_ids", "stream kernel")


# The query builder, over every query of the search log. In SQL: words, parentheses apart, cleaned of special characters.
_WORDS = "list_filter(list_transform(regexp_extract_all(query, '\"[^\"]*\"|[()]|[^\\s()]\\S*'), lambda w: {clean}), lambda w: w <> '')"
_CLEAN = "trim(regexp_replace(regexp_replace(w, '[*^(){}<>]', ' ', 'g'), '\\s+', ' ', 'g'))"
_ASKED = "SELECT DISTINCT query FROM ss WHERE query IS NOT NULL AND NOT contains(query, '\"')"
_IS_OP = "upper(w) IN ('AND', 'OR', 'NOT', 'NEAR')"
_ANY = f"SELECT query AS asked, array_to_string(list_transform(list_filter({_WORDS.format(clean='w')}, lambda w: NOT ({_IS_OP}) AND {_CLEAN} <> ''), lambda w: concat('\"', substr({_CLEAN}, 1, 128), '\"')), ' OR ') AS parsed FROM ({_ASKED})"
_PHRASE = f"SELECT query AS asked, CASE WHEN p = '' THEN '' ELSE concat('\"', p, '\"') END AS parsed FROM (SELECT query, substr(trim(regexp_replace(regexp_replace(query, '[*^(){{}}<>]', ' ', 'g'), '\\s+', ' ', 'g')), 1, 256) AS p FROM ({_ASKED}))"
# Strict: words with their place; a term's operator is the last operator word since the term before it.
_STRICT = f"""WITH a AS ({_ASKED}), w AS (SELECT query, unnest(x) AS w, unnest(range(len(x))) AS i FROM (SELECT query, {_WORDS.format(clean='w')} AS x FROM a)),
t AS (SELECT *, {_IS_OP} AS isop, {_CLEAN} AS c FROM w WHERE w NOT IN ('(', ')')), u AS (SELECT *, sum(CASE WHEN NOT isop AND c <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY query ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM t),
o AS (SELECT query, coalesce(n, 0) AS n, arg_max(upper(w), i) AS op FROM u WHERE isop AND coalesce(n, 0) > 0 GROUP BY 1, 2),
r AS (SELECT u.query, u.i, concat(CASE WHEN coalesce(u.n, 0) = 0 THEN '' ELSE concat(' ', coalesce(o.op, 'AND'), ' ') END, '"', substr(u.c, 1, 128), '"') AS part FROM u LEFT JOIN o ON o.query = u.query AND o.n = coalesce(u.n, 0) WHERE NOT isop AND c <> '')
SELECT a.query AS asked, coalesce(string_agg(part, '' ORDER BY i), '') AS parsed FROM a LEFT JOIN r ON r.query = a.query GROUP BY 1"""


def _parsed(mode, sql):
    @query(f"fts_query_{mode}", sql)
    def run(spark, d):
        """The match expression of every logged query without quotes (those are tested on their own)."""
        import pandas as pd

        def build(queries: pd.Series) -> pd.Series:
            return queries.map(lambda q: fts.render(fts.parse(q, mode)))

        build.__annotations__ = {"queries": pd.Series, "return": pd.Series}
        asked = B.sessions(spark, d).select(F.col("query").alias("asked")).where("asked is not null").where(~F.col("asked").contains('"')).distinct()
        return asked.select("asked", F.pandas_udf(build, "string")("asked").alias("parsed"))


for _mode, _sql in (("strict", _STRICT), ("any", _ANY), ("phrase", _PHRASE)):
    _parsed(_mode, _sql)
