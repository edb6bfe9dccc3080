"""Queries over the catalog: lookups, merges, deletes, statistics, change sets and pruning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators.mining import auto_trigger as replay_trigger
from ..operators.mining import co_retrieved
from ..operators.vector import shards
from ..session import table
from . import base as B
from .base import query, us

AS_OF = "2025-01-15 00:00:00"
_AS_OF_US = 1736899200000000


# Lookups and lists.
@query("get_chunk", "SELECT chunk_id, project_id, internal_id, token_count FROM c WHERE chunk_id = (SELECT min(chunk_id) FROM chunks)")
def get_chunk(spark, d):
    first = table(spark, d, "chunks").agg(F.min("chunk_id")).first()[0]
    return B.chunks(spark, d).where(F.col("chunk_id") == first).select("chunk_id", "project_id", "internal_id", "token_count")


@query("project_info", "SELECT project_id, project_name, directory, embedding_dim FROM pr WHERE project_id = (SELECT min(project_id) FROM projects)")
def project_info(spark, d):
    first = table(spark, d, "projects").agg(F.min("project_id")).first()[0]
    return B.projects(spark, d).where(F.col("project_id") == first).select("project_id", "project_name", "directory", "embedding_dim")


@query("fetch_chunks_by_ids", "WITH w AS (SELECT unnest(result_chunk_ids) AS chunk_id, unnest(range(len(result_chunk_ids))) AS pos FROM ss WHERE session_id = (SELECT min(session_id) FROM search_sessions WHERE len(result_chunk_ids) > 3)) SELECT pos, w.chunk_id, length(content) AS n_chars FROM w JOIN c ON c.chunk_id = w.chunk_id")
def fetch_chunks_by_ids(spark, d):
    """The chunks of one search in the order of its result; vanished ones are missing."""
    s = B.sessions(spark, d)
    first = s.where(F.size("result_chunk_ids") > 3).agg(F.min("session_id")).first()[0]
    want = s.where(F.col("session_id") == first).select(F.posexplode("result_chunk_ids").alias("pos", "chunk_id"))
    return want.join(B.chunks(spark, d).select("chunk_id", F.length("content").cast("long").alias("n_chars")), "chunk_id").select(F.col("pos").cast("long").alias("pos"), "chunk_id", "n_chars").orderBy("pos")


@query("chunk_batch_scan", "SELECT project_id, internal_id, bytes, CAST(floor(before / 65536) AS BIGINT) AS page FROM (SELECT project_id, internal_id, bytes, sum(bytes) OVER (PARTITION BY project_id ORDER BY internal_id) - bytes AS before FROM (SELECT project_id, internal_id, coalesce(strlen(content), 0) AS bytes FROM c WHERE project_id IS NOT NULL AND internal_id IS NOT NULL))")
def chunk_batch_scan(spark, d):
    rows = B.chunks(spark, d).where("project_id is not null and internal_id is not null")
    return C.byte_pages(rows, "project_id", "internal_id", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long"), 65536)


@query("file_chunk_ids", "SELECT project_id, file_path, string_agg(chunk_id, ',' ORDER BY chunk_id) AS chunk_ids, count(*) AS n FROM fc GROUP BY 1, 2")
def file_chunk_ids(spark, d):
    return B.links(spark, d).groupBy("project_id", "file_path").agg(F.array_join(F.sort_array(F.collect_list("chunk_id")), ",").alias("chunk_ids"), F.count("*").alias("n"))


@query("list_projects", "SELECT project_id, project_name, epoch_us(updated_at) AS updated_us FROM pr WHERE NOT deleting")
def list_projects(spark, d):
    return B.projects(spark, d).where(~F.col("deleting")).select("project_id", "project_name", us("updated_at").alias("updated_us")).orderBy(F.desc("updated_us"), "project_id")


@query("list_jobs", "SELECT job_id, project_id, kind, status, epoch_us(created_at) AS created_us FROM jb")
def list_jobs(spark, d):
    return B.jobs(spark, d).select("job_id", "project_id", "kind", "status", us("created_at").alias("created_us")).orderBy(F.desc("created_us"), "job_id")


# Merges and deletes. Old and new overlap in part of the ids.
_OLD_NEW = f"WITH o AS (SELECT chunk_id, internal_id, coalesce(access_count, 0) AS access_count, epoch_us(updated_at) AS at FROM c WHERE chunk_id <= '9'), n AS (SELECT chunk_id, internal_id + 1000000 AS internal_id, coalesce(access_count, 0) + 1 AS access_count, {_AS_OF_US} AS at FROM c WHERE chunk_id >= '6')"


def _old_new(spark, d):
    c = B.chunks(spark, d)
    old = c.where("chunk_id <= '9'").select("chunk_id", "internal_id", F.coalesce("access_count", F.lit(0)).alias("access_count"), us("updated_at").alias("at"))
    new = c.where("chunk_id >= '6'").select("chunk_id", (F.col("internal_id") + 1_000_000).alias("internal_id"), (F.coalesce("access_count", F.lit(0)) + 1).alias("access_count"), F.lit(_AS_OF_US).alias("at"))
    # An earlier write of the same batch, which the later one replaces.
    early = new.withColumns({"at": F.col("at") - 1, "access_count": F.lit(-1).cast("long")})
    return old, early.unionByName(new)


@query("upsert_merge", _OLD_NEW + " SELECT coalesce(n.chunk_id, o.chunk_id) AS chunk_id, CASE WHEN o.chunk_id IS NOT NULL THEN o.internal_id ELSE n.internal_id END AS internal_id, CASE WHEN o.chunk_id IS NOT NULL THEN o.access_count ELSE n.access_count END AS access_count, CASE WHEN n.chunk_id IS NOT NULL THEN n.at ELSE o.at END AS at FROM o FULL JOIN n ON o.chunk_id = n.chunk_id")
def upsert_merge(spark, d):
    """An existing chunk keeps its internal_id and access_count."""
    old, new = _old_new(spark, d)
    return C.upsert(old, new, ["chunk_id"], ["internal_id", "access_count"], [F.desc("at")])


@query("insert_ignore", "WITH o AS (SELECT DISTINCT chunk_id FROM fc), n AS (SELECT DISTINCT x.id AS chunk_id FROM ss, unnest(result_chunk_ids) AS x(id) WHERE x.id IS NOT NULL) SELECT chunk_id, 'old' AS origin FROM o UNION ALL SELECT chunk_id, 'new' FROM n WHERE chunk_id NOT IN (SELECT chunk_id FROM o)")
def insert_ignore(spark, d):
    old = B.links(spark, d).select("chunk_id").distinct().withColumn("origin", F.lit("old"))
    new = B.sessions(spark, d).select(F.explode("result_chunk_ids").alias("chunk_id")).where("chunk_id is not null").withColumn("origin", F.lit("new"))
    return C.insert_ignore(old, new, ["chunk_id"])


@query("internal_id_repair", """WITH b AS (SELECT DISTINCT project_id, concat('new-', chunk_id) AS chunk_id, CASE WHEN chunk_id < '8' THEN internal_id ELSE internal_id + 1000000 END AS internal_id FROM c WHERE project_id IS NOT NULL AND internal_id IS NOT NULL),
t AS (SELECT project_id, chunk_id, internal_id FROM c WHERE project_id IS NOT NULL AND internal_id IS NOT NULL), m AS (SELECT project_id, max(internal_id) AS top FROM t GROUP BY 1),
j AS (SELECT b.*, t.chunk_id IS NOT NULL AS hit, m.top FROM b LEFT JOIN t ON t.project_id = b.project_id AND t.internal_id = b.internal_id LEFT JOIN m ON m.project_id = b.project_id)
SELECT project_id, chunk_id, CASE WHEN hit THEN top + row_number() OVER (PARTITION BY project_id, hit ORDER BY chunk_id) ELSE internal_id END AS internal_id FROM j""")
def internal_id_repair(spark, d):
    held = B.chunks(spark, d).where("project_id is not null and internal_id is not null").select("project_id", "chunk_id", "internal_id")
    batch = held.select("project_id", F.concat(F.lit("new-"), "chunk_id").alias("chunk_id"), F.when(F.col("chunk_id") < "8", F.col("internal_id")).otherwise(F.col("internal_id") + 1_000_000).alias("internal_id"))
    return C.repair_ids(batch, held, "project_id", "chunk_id", "internal_id")


@query("delete_cascade", "WITH g AS (SELECT project_id FROM pr WHERE deleting OR index_dirty) SELECT 'chunks' AS tbl, count(*) AS n FROM c WHERE project_id NOT IN (SELECT project_id FROM g) UNION ALL SELECT 'files', count(*) FROM fm WHERE project_id NOT IN (SELECT project_id FROM g) UNION ALL SELECT 'links', count(*) FROM fc WHERE project_id NOT IN (SELECT project_id FROM g) UNION ALL SELECT 'sessions', count(*) FROM ss WHERE project_id NOT IN (SELECT project_id FROM g)")
def delete_cascade(spark, d):
    """What is left of each table when the projects marked for it are gone."""
    gone = B.projects(spark, d).where("deleting or index_dirty").select("project_id")
    out = None
    for name, df in (("chunks", B.chunks(spark, d)), ("files", B.files(spark, d)), ("links", B.links(spark, d)), ("sessions", B.sessions(spark, d))):
        part = C.delete(df.where("project_id is not null"), gone, ["project_id"]).agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n")
        out = part if out is None else out.unionByName(part)
    return out


# Statistics.
@query("project_stats", "SELECT project_id, count(*) AS chunk_count, CAST(coalesce(sum(token_count), 0) AS BIGINT) AS total_tokens FROM c GROUP BY 1")
def project_stats(spark, d):
    return B.chunks(spark, d).groupBy("project_id").agg(F.count("*").alias("chunk_count"), F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("total_tokens"))


@query("access_counts", "WITH e AS (SELECT x.id AS chunk_id, count(*) AS plus FROM ss, unnest(list_distinct(result_chunk_ids)) AS x(id) WHERE x.id IS NOT NULL GROUP BY 1) SELECT c.chunk_id, coalesce(access_count, 0) + coalesce(plus, 0) AS access_count FROM c LEFT JOIN e ON e.chunk_id = c.chunk_id")
def access_counts(spark, d):
    plus = B.sessions(spark, d).select(F.explode(F.array_distinct("result_chunk_ids")).alias("chunk_id")).where("chunk_id is not null").groupBy("chunk_id").agg(F.count("*").alias("plus"))
    return B.chunks(spark, d).select("chunk_id", "access_count").join(plus, "chunk_id", "left").select("chunk_id", (F.coalesce("access_count", F.lit(0)) + F.coalesce("plus", F.lit(0))).alias("access_count"))


@query("job_latest_status", "SELECT project_id, kind, arg_max(status, (updated_at, job_id)) AS status, count(*) AS n FROM jb WHERE updated_at IS NOT NULL GROUP BY 1, 2")
def job_latest_status(spark, d):
    return B.jobs(spark, d).where("updated_at is not null").groupBy("project_id", "kind").agg(F.max_by("status", F.struct("updated_at", "job_id")).alias("status"), F.count("*").alias("n"))


@query("explode_chunk_ids", "SELECT session_id, x.id AS chunk_id, count(*) AS n FROM ss, unnest(result_chunk_ids) AS x(id) WHERE x.id IS NOT NULL GROUP BY 1, 2")
def explode_chunk_ids(spark, d):
    return B.sessions(spark, d).select("session_id", F.explode("result_chunk_ids").alias("chunk_id")).where("chunk_id is not null").groupBy("session_id", "chunk_id").agg(F.count("*").alias("n"))


@query("codebase_stats", "SELECT fm.project_id, count(DISTINCT fm.file_path) AS n_files, count(DISTINCT c.chunk_id) AS n_chunks FROM fm LEFT JOIN fc ON fc.project_id = fm.project_id AND fc.file_path = fm.file_path LEFT JOIN c ON c.chunk_id = fc.chunk_id GROUP BY 1")
def codebase_stats(spark, d):
    rows = B.files(spark, d).select("project_id", "file_path").join(B.links(spark, d), ["project_id", "file_path"], "left").join(B.chunks(spark, d).select("chunk_id", F.lit(True).alias("there")), "chunk_id", "left")
    return rows.groupBy("project_id").agg(F.countDistinct("file_path").alias("n_files"), F.countDistinct(F.when(F.col("there"), F.col("chunk_id"))).alias("n_chunks"))


@query("top_directories", "SELECT project_id, dir, cnt FROM (SELECT project_id, dir, count(*) AS cnt, row_number() OVER (PARTITION BY project_id ORDER BY count(*) DESC, dir) AS r FROM (SELECT project_id, CASE WHEN contains(file_path, '/') THEN split_part(file_path, '/', 1) ELSE '' END AS dir FROM fm) WHERE dir <> '' GROUP BY 1, 2) WHERE r <= 25")
def top_directories(spark, d):
    rows = B.files(spark, d).select("project_id", F.when(F.instr("file_path", "/") > 0, F.substring_index("file_path", "/", 1)).otherwise("").alias("dir")).where("dir <> ''")
    counts = rows.groupBy("project_id", "dir").agg(F.count("*").alias("cnt"))
    w = Window.partitionBy("project_id").orderBy(F.desc("cnt"), "dir")
    return counts.withColumn("r", F.row_number().over(w)).where("r <= 25").drop("r")


@query("language_breakdown", "SELECT project_id, ext, cnt FROM (SELECT project_id, ext, count(*) AS cnt, row_number() OVER (PARTITION BY project_id ORDER BY count(*) DESC, ext) AS r FROM (SELECT project_id, CASE WHEN contains(file_path, '.') THEN lower(substr(file_path, strpos(file_path, '.') + 1)) ELSE '' END AS ext FROM fm) WHERE ext <> '' GROUP BY 1, 2) WHERE r <= 10")
def language_breakdown(spark, d):
    """By what stands after the first dot of the path."""
    rows = B.files(spark, d).select("project_id", F.when(F.instr("file_path", ".") > 0, F.lower(F.expr("substring(file_path, instr(file_path, '.') + 1)"))).otherwise("").alias("ext")).where("ext <> ''")
    counts = rows.groupBy("project_id", "ext").agg(F.count("*").alias("cnt"))
    w = Window.partitionBy("project_id").orderBy(F.desc("cnt"), "ext")
    return counts.withColumn("r", F.row_number().over(w)).where("r <= 10").drop("r")


@query("top_modified_files", "SELECT project_id, file_path, mtime_ns FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY mtime_ns DESC NULLS LAST, file_path) AS r FROM fm) WHERE r <= 5")
def top_modified_files(spark, d):
    w = Window.partitionBy("project_id").orderBy(F.desc_nulls_last("mtime_ns"), "file_path")
    return B.files(spark, d).select("project_id", "file_path", "mtime_ns").withColumn("r", F.row_number().over(w)).where("r <= 5").drop("r")


@query("duplicate_ids", "SELECT project_id, internal_id, count(DISTINCT chunk_id) AS n FROM chunks GROUP BY 1, 2 HAVING count(DISTINCT chunk_id) > 1 OR count(*) > 1")
def duplicate_ids(spark, d):
    """Numbers that stand in more than one row."""
    rows = table(spark, d, "chunks").groupBy("project_id", "internal_id").agg(F.countDistinct("chunk_id").alias("n"), F.count("*").alias("all_rows"))
    return rows.where("all_rows > 1").drop("all_rows")


@query("memory_bank", "SELECT fm.project_id, replace(replace(fm.file_path, 'vfs://memory/', ''), '.md', '') AS section, count(c.chunk_id) AS n_chunks, coalesce(string_agg(content, chr(10) || chr(10) ORDER BY internal_id, c.chunk_id) FILTER (WHERE content <> ''), '') AS content FROM fm LEFT JOIN fc ON fc.project_id = fm.project_id AND fc.file_path = fm.file_path LEFT JOIN c ON c.chunk_id = fc.chunk_id WHERE starts_with(fm.file_path, 'vfs://memory/') GROUP BY 1, 2")
def memory_bank(spark, d):
    rows = B.files(spark, d).where(F.col("file_path").startswith("vfs://memory/")).select("project_id", "file_path").join(B.links(spark, d), ["project_id", "file_path"], "left").join(B.chunks(spark, d).select("chunk_id", "internal_id", "content", F.lit(1).alias("there")), "chunk_id", "left")
    rows = rows.withColumn("section", F.replace(F.replace("file_path", F.lit("vfs://memory/"), F.lit("")), F.lit(".md"), F.lit("")))
    part = F.when(F.col("content") != "", F.struct("internal_id", "chunk_id", "content"))
    out = rows.groupBy("project_id", "section").agg(F.count("there").alias("n_chunks"), F.sort_array(F.collect_list(part)).alias("parts"))
    return out.select("project_id", "section", "n_chunks", F.array_join(F.transform("parts", lambda p: p["content"]), "\n\n").alias("content"))


@query("reserve_internal_ids", "WITH m AS (SELECT project_id, max(internal_id) AS top FROM c GROUP BY 1) SELECT f.project_id, file_path, coalesce(top, 0) + row_number() OVER (PARTITION BY f.project_id ORDER BY file_path) AS internal_id FROM (SELECT DISTINCT project_id, file_path FROM fm) f LEFT JOIN m ON m.project_id = f.project_id")
def reserve_internal_ids(spark, d):
    top = B.chunks(spark, d).groupBy("project_id").agg(F.max("internal_id").alias("top"))
    rows = C.numbered(B.files(spark, d).select("project_id", "file_path").distinct(), ["file_path"], "nth", 0, ["project_id"]).join(top, "project_id", "left")
    return rows.select("project_id", "file_path", (F.coalesce("top", F.lit(0)) + F.col("nth")).alias("internal_id"))


@query("project_limits", "SELECT project_id, count(*) AS n_files, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS n_bytes, count(*) <= 100000 AND coalesce(sum(size_bytes), 0) <= 5368709120 AS within_limits FROM fm GROUP BY 1")
def project_limits(spark, d):
    sums = B.files(spark, d).groupBy("project_id").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("n_bytes"))
    return sums.withColumn("within_limits", (F.col("n_files") <= 100_000) & (F.col("n_bytes") <= 5 * 1024**3))


@query("project_health", "SELECT pr.project_id, count(c.chunk_id) AS n_chunks, count(c.vector) AS n_vectors, any_value(pr.chunk_count) AS said, any_value(pr.chunk_count) = count(c.chunk_id) AS agrees FROM pr LEFT JOIN c ON c.project_id = pr.project_id GROUP BY 1")
def project_health(spark, d):
    rows = B.projects(spark, d).select("project_id", "chunk_count").join(B.chunks(spark, d).select("project_id", "chunk_id", "vector"), "project_id", "left")
    out = rows.groupBy("project_id").agg(F.count("chunk_id").alias("n_chunks"), F.count("vector").alias("n_vectors"), F.max("chunk_count").alias("said"))
    return out.withColumn("agrees", F.col("said") == F.col("n_chunks"))


@query("shard_count", "SELECT project_id, count(*) AS n, CAST(CASE WHEN count(*) < 1000000 THEN 1 ELSE ceil(count(*) / 250000.0) END AS BIGINT) AS shards, CAST(CASE WHEN count(*) < 100 THEN 1 ELSE ceil(count(*) / 40.0) END AS BIGINT) AS shards_of_40 FROM c GROUP BY 1")
def shard_count(spark, d):
    """Shards of each project by the default sizes, and by sizes that these tables reach."""
    n = B.chunks(spark, d).groupBy("project_id").agg(F.count("*").alias("n"))
    return n.select("project_id", "n", shards(F.col("n")).alias("shards"), shards(F.col("n"), 100, 40).alias("shards_of_40"))


@query("shard_assign", "SELECT chunk_id, internal_id % 4 AS shard FROM c WHERE internal_id IS NOT NULL")
def shard_assign(spark, d):
    return B.chunks(spark, d).where("internal_id is not null").select("chunk_id", F.pmod("internal_id", F.lit(4)).alias("shard"))


# Change sets: what the newest scans say against the snapshot.
_SCAN = "WITH o AS (SELECT project_id, file_path, mtime_ns, size_bytes, content_hash FROM fm WHERE NOT starts_with(file_path, 'vfs://')), n AS (SELECT project_id, file_path, mtime_ns, size_bytes, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY project_id, file_path ORDER BY observed_at DESC, scan_id DESC) AS r FROM file_scans WHERE NOT starts_with(file_path, 'vfs://')) WHERE r = 1)"
_CHANGE = "CASE WHEN o.project_id IS NULL THEN 'added' WHEN n.project_id IS NULL THEN 'deleted' WHEN coalesce(o.mtime_ns = n.mtime_ns AND o.size_bytes = n.size_bytes, false) OR coalesce(o.content_hash = n.content_hash, false) THEN 'unchanged' ELSE 'modified' END"
_JOIN = "o FULL JOIN n ON o.project_id = n.project_id AND o.file_path = n.file_path"


def _snapshots(spark, d):
    cols = ["project_id", "file_path", "mtime_ns", "size_bytes", "content_hash"]
    real = ~F.col("file_path").startswith("vfs://")
    new = C.newest(table(spark, d, "file_scans").where(real), ["project_id", "file_path"], [F.desc("observed_at"), F.desc("scan_id")])
    return B.files(spark, d).where(real).select(*cols), new.select(*cols)


@query("changed_files", f"{_SCAN} SELECT coalesce(n.project_id, o.project_id) AS project_id, coalesce(n.file_path, o.file_path) AS file_path, {_CHANGE} AS change FROM {_JOIN}")
def changed_files(spark, d):
    return C.snapshot_changes(*_snapshots(spark, d), ["project_id", "file_path"])


@query("deleted_files", f"{_SCAN} SELECT project_id, file_path FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.project_id = o.project_id AND n.file_path = o.file_path)")
def deleted_files(spark, d):
    old, new = _snapshots(spark, d)
    return old.select("project_id", "file_path").join(new, ["project_id", "file_path"], "left_anti")


@query("incremental_update", f"""{_SCAN}, ch AS (SELECT coalesce(n.project_id, o.project_id) AS project_id, coalesce(n.file_path, o.file_path) AS file_path, {_CHANGE} AS change, o.content_hash AS old_hash, n.content_hash AS new_hash FROM {_JOIN}),
lk AS (SELECT project_id, file_path, count(*) AS k FROM fc GROUP BY 1, 2)
SELECT ch.project_id, ch.file_path, change, coalesce(CASE WHEN change = 'deleted' THEN NULL WHEN change = 'unchanged' THEN coalesce(new_hash, old_hash) ELSE new_hash END, '') AS content_hash, CASE WHEN change IN ('deleted', 'modified') THEN coalesce(k, 0) ELSE 0 END AS chunks_out FROM ch LEFT JOIN lk ON lk.project_id = ch.project_id AND lk.file_path = ch.file_path""")
def incremental_update(spark, d):
    """What an update does to every file: its change, the hash it has afterwards, and how many of its chunks go."""
    old, new = _snapshots(spark, d)
    rows = C.incremental_update(old, new, B.links(spark, d), ["project_id", "file_path"])
    return rows.withColumn("content_hash", F.coalesce("content_hash", F.lit("")))


@query("distinct_ids", "SELECT session_id, pos, chunk_id FROM (SELECT session_id, id AS chunk_id, row_number() OVER (PARTITION BY session_id ORDER BY min(p)) - 1 AS pos FROM (SELECT session_id, unnest(result_chunk_ids) AS id, unnest(range(len(result_chunk_ids))) AS p FROM ss) WHERE id IS NOT NULL GROUP BY 1, 2)")
def distinct_ids(spark, d):
    """Each search's ids once, in the order in which they come first."""
    rows = B.sessions(spark, d).select("session_id", F.posexplode(F.array_compact(F.array_distinct("result_chunk_ids"))).alias("pos", "chunk_id"))
    return rows.select("session_id", F.col("pos").cast("long").alias("pos"), "chunk_id")


# Pruning, as of a given time.
@query("prune_sessions", f"SELECT session_id FROM (SELECT session_id, created_at, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC NULLS LAST, session_id) AS r FROM ss WHERE epoch_us(created_at) >= {_AS_OF_US} - 10 * 86400000000) WHERE r <= 20")
def prune_sessions(spark, d):
    """What stays: the newest 20 searches of each project, none older than ten days."""
    since = F.timestamp_micros(F.lit(_AS_OF_US - 10 * 86_400_000_000))
    return C.keep_newest(B.sessions(spark, d).select("project_id", "session_id", "created_at"), "created_at", "session_id", 20, since, ["project_id"]).select("session_id")


@query("prune_cache", f"SELECT content_hash, coalesce(model_name, '') AS model FROM (SELECT content_hash, model_name, row_number() OVER (ORDER BY created_at DESC, content_hash, model_name) AS r FROM ec WHERE epoch_us(created_at) >= {_AS_OF_US} - 200 * 86400000000) WHERE r <= 300")
def prune_cache(spark, d):
    """What stays: the newest 300 entries, none older than 200 days. A top-k, not a global window."""
    rows = B.cache(spark, d).where(F.col("created_at") >= F.timestamp_micros(F.lit(_AS_OF_US - 200 * 86_400_000_000)))
    return rows.orderBy(F.desc("created_at"), "content_hash", F.asc_nulls_last("model_name")).limit(300).select("content_hash", F.coalesce("model_name", F.lit("")).alias("model"))


@query("prune_jobs", f"SELECT job_id FROM jb WHERE epoch_us(created_at) < {_AS_OF_US} - 5 * 86400000000 OR job_id NOT IN (SELECT job_id FROM jb ORDER BY created_at DESC, job_id LIMIT 200)")
def prune_jobs(spark, d):
    """What goes: jobs older than five days, and all but the newest 200."""
    j = B.jobs(spark, d).select("job_id", "created_at")
    keep = C.keep_newest(j, "created_at", "job_id", 200).where(F.col("created_at") >= F.timestamp_micros(F.lit(_AS_OF_US - 5 * 86_400_000_000)))
    return j.join(keep.select("job_id"), "job_id", "left_anti").select("job_id")


@query("stale_jobs", "SELECT job_id, CASE WHEN status IN ('QUEUED', 'PROCESSING') THEN 'FAILED' ELSE status END AS status, CASE WHEN status IN ('QUEUED', 'PROCESSING') THEN 'stale' ELSE coalesce(error, '') END AS error FROM jb")
def stale_jobs(spark, d):
    stale = F.col("status").isin("QUEUED", "PROCESSING")
    return B.jobs(spark, d).select("job_id", F.when(stale, "FAILED").otherwise(F.col("status")).alias("status"), F.when(stale, "stale").otherwise(F.coalesce("error", F.lit(""))).alias("error"))


@query("dream_candidates", """WITH r AS (SELECT project_id, session_id, list_filter(list_distinct(result_chunk_ids), lambda x: x IS NOT NULL) AS ids, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, session_id) AS rn FROM ss WHERE project_id IS NOT NULL),
fl AS (SELECT project_id, chunk_id, min(file_path) AS file_path FROM fc GROUP BY 1, 2),
i AS (SELECT r.project_id, session_id, x.id AS chunk_id, file_path FROM r, unnest(ids) AS x(id) JOIN fl ON fl.project_id = r.project_id AND fl.chunk_id = x.id WHERE rn <= 500 AND len(ids) > 1),
kn AS (SELECT least(x, y) AS chunk_a, greatest(x, y) AS chunk_b FROM (SELECT json_extract_string(m, '$.source_chunks[0]') AS x, json_extract_string(m, '$.source_chunks[1]') AS y FROM (SELECT CASE WHEN json_valid(metadata) THEN metadata END AS m FROM c) WHERE json_extract_string(m, '$.type') = 'insight'))
SELECT a.project_id, a.chunk_id AS chunk_a, b.chunk_id AS chunk_b, count(*) AS pair_count FROM i a JOIN i b ON a.project_id = b.project_id AND a.session_id = b.session_id AND a.chunk_id < b.chunk_id AND a.file_path <> b.file_path ANTI JOIN kn ON kn.chunk_a = a.chunk_id AND kn.chunk_b = b.chunk_id GROUP BY 1, 2, 3""")
def dream_candidates(spark, d):
    first = B.links(spark, d).groupBy("project_id", "chunk_id").agg(F.min("file_path").alias("file_path"))
    m = lambda p: F.get_json_object("metadata", p)
    known = B.chunks(spark, d).where(m("$.type") == "insight").select(m("$.source_chunks[0]").alias("chunk_a"), m("$.source_chunks[1]").alias("chunk_b"))
    return co_retrieved(B.sessions(spark, d), first, known)


# The trigger as a recursion over each project's searches in order: 25 of them, 300 seconds since the last start, one start a day.
_TRIGGER = """WITH RECURSIVE o AS (SELECT project_id, epoch_us(created_at) / 1000000.0 AS t, strftime(created_at, '%Y-%m-%d') AS today, row_number() OVER (PARTITION BY project_id ORDER BY created_at, session_id) AS n FROM (SELECT DISTINCT * FROM search_sessions WHERE session_id IS NOT NULL AND project_id IS NOT NULL AND created_at IS NOT NULL)),
s AS (SELECT project_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS prev, '' AS d, CAST(0 AS BIGINT) AS runs, CAST(0 AS BIGINT) AS nth, false AS fired, CAST(0 AS DOUBLE) AS t FROM (SELECT DISTINCT project_id FROM o)
UNION ALL SELECT project_id, n, CASE WHEN fire THEN CAST(0 AS BIGINT) ELSE k END, CASE WHEN fire THEN t ELSE prev END, today, CASE WHEN fire THEN runs + 1 ELSE runs END, CASE WHEN fire THEN nth + 1 ELSE nth END, fire, t
  FROM (SELECT *, k >= 25 AND t - prev >= 300 AND runs < 1 AS fire FROM (SELECT s.project_id, o.n, s.k + 1 AS k, s.prev, o.today, CASE WHEN o.today <> s.d THEN CAST(0 AS BIGINT) ELSE s.runs END AS runs, s.nth, CAST(o.t AS DOUBLE) AS t FROM s JOIN o ON o.project_id = s.project_id AND o.n = s.n + 1)))
SELECT project_id, t AS fired_at, CAST(nth AS INTEGER) AS nth FROM s WHERE fired"""


@query("auto_trigger", _TRIGGER, base=False)
def auto_trigger(spark, d):
    return replay_trigger(B.sessions(spark, d))


@query("insight_prompt", "SELECT a.chunk_id, concat('Context A:', chr(10), a.content, chr(10), chr(10), 'Context B:', chr(10), b.content, chr(10), chr(10), 'Insight:') AS prompt FROM c a JOIN c b ON b.project_id = a.project_id AND b.internal_id = a.internal_id + 1 WHERE a.content IS NOT NULL AND b.content IS NOT NULL")
def insight_prompt(spark, d):
    """A prompt for each chunk and the one after it."""
    a = B.chunks(spark, d).where("content is not null").select("project_id", "internal_id", "chunk_id", "content")
    b = a.select("project_id", (F.col("internal_id") - 1).alias("internal_id"), F.col("content").alias("other"))
    said = F.concat(F.lit("Context A:\n"), "content", F.lit("\n\nContext B:\n"), "other", F.lit("\n\nInsight:"))
    return a.join(b, ["project_id", "internal_id"]).select("chunk_id", said.alias("prompt"))
