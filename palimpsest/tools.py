"""The public functions: a memory of projects over versioned tables.

Every function builds plans from the operators; results come to the driver only where they are a bounded answer
(a top k, one row, counts), the edges of one node or a project's memory bank. Tables live below one path, a part for each
project, and are swapped atomically; logs are appended to. A search reads the stored postings of its words.
"""

from __future__ import annotations

import json
import math
import os
import time
import unicodedata
import uuid
from collections import OrderedDict
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions.glob import IGNORED, TEXT_EXTENSIONS, extension
from .operators import catalog, fts, fusion, graph, history, mining, vector
from .session import cut, ship
from .sources import documents
from .sources import files as sources
from .sources.store import VersionedTable

SCHEMAS = {
    "projects": "project_id string, project_name string, project_type string, directory string, metadata string, chunk_count long, file_count long, total_tokens long, updated_at double",
    "chunks": "project_id string, chunk_id string, internal_id long, file_path string, content string, token_count int, metadata string, vector array<double>, access_count long, start_line int, end_line int",
    "postings": "project_id string, chunk_id string, term string, tf long, dl long, positions array<int>",
    "text_totals": "project_id string, docs long, tokens long",
    "embedding_cache": "content_hash string, model_name string, embedding array<double>, created_at double",
    "file_metadata": "project_id string, file_path string, mtime_ns long, size_bytes long, content_hash string",
    "graph_nodes": "project_id string, node_id string, node_type string, name string, file_path string, start_line int, end_line int",
    "graph_edges": "project_id string, source_id string, target_id string, edge_type string",
    "git_commits": "commit_hash string, project_id string, author string, timestamp long, message string, embedding_uuid string",
    "git_diffs": "id string, commit_hash string, project_id string, file_path string, change_type string, diff_content string",
    "git_tags": "project_id string, commit_hash string, tag string",
    "search_sessions": "session_id string, project_id string, query string, result_chunk_ids array<string>, created_at timestamp",
    "repo_rules": "rule_id string, project_id string, file_pattern string, rule_text string, priority int",
    "jobs": "job_id string, kind string, project_id string, status string, at double, error string",
}
#: Tables that a project's end takes along.
OWNED = tuple(n for n in SCHEMAS if n not in ("projects", "embedding_cache"))
MAX_QUERY_CHARS, MAX_QUERY_TOKENS = 4096, 256
#: Search answers held for a while, by project, query and parameters.
CACHE_ITEMS, CACHE_SECONDS = 512, 300.0
#: Tokens of a prompt, of which the two contexts take three quarters.
CONTEXT_WINDOW = 2048
MAX_PAIRS = 100
DOCUMENTS = (".pdf", ".docx")
INSIGHTS, COMMITS = "vfs://insights/dream_cycle.md", "vfs://git_history"
DONE = ("COMPLETED", "FAILED", "CANCELLED")


class Memory:
    """Projects, their chunks, history and searches below `path`; directories must lie in `roots`.

    `embedder` is a column function text -> array<double> of `dim` numbers, known as `model`; `generator` one of
    prompts, or a plain function of one prompt; `extractor` a function of a source's text (see graph.extract_symbols).
    """

    def __init__(self, spark: SparkSession, path: str, roots: list[str] | None = None, embedder=None, dim: int = 64, target: int = 200, overlap: int = 30, generator=None, model: str = "hashing", extractor=None, ignore=IGNORED, auto_dream: bool = False, auto_every: int = 25, auto_gap_s: int = 300, auto_per_day: int = 1, auto_pairs: int = 10):
        ship(spark)
        self.spark, self.path, self.roots, self.dim, self.model = spark, path, roots or [], dim, model
        self.embed = embedder or vector.hashing_embedder(dim)
        self.generate = _batched(generator or (lambda prompt: "NO_INSIGHT"))
        self.target, self.overlap, self.extractor, self.ignore = target, overlap, extractor, ignore
        self._auto = (auto_every, auto_gap_s, auto_per_day, auto_pairs) if auto_dream else None
        self._triggers: dict[str, mining.TriggerState] = {}
        self._answers: OrderedDict[tuple, tuple[float, dict]] = OrderedDict()

    # Tables.
    @cached_property
    def _tables(self) -> dict[str, VersionedTable]:
        return {n: VersionedTable(self.spark, f"{self.path}/{n}") for n in SCHEMAS}

    def _empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], SCHEMAS[name])

    def table(self, name: str, project_id: str | None = None) -> DataFrame:
        """A table, or one project's part of it."""
        df = self._tables[name].load(part=project_id)
        return self._empty(name) if df is None else df

    def _cast(self, name: str, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c.name).cast(c.dataType) for c in self._empty(name).schema])

    def _change(self, name: str, project_id: str, make: Callable[[DataFrame], DataFrame | None]) -> None:
        """A project's part of a table replaced by what `make` gives of it, anew where another writer came between."""

        def rows(old: DataFrame | None) -> DataFrame | None:
            new = make(self._empty(name) if old is None else old)
            return None if new is None else self._cast(name, new)

        self._tables[name].change(project_id, rows)
        self._forget(project_id)

    def _add(self, name: str, part: str, rows: DataFrame) -> None:
        self._tables[name].append(part, self._cast(name, rows))

    def _forget(self, project_id: str) -> None:
        for asked in [a for a in self._answers if a[0] == project_id]:
            del self._answers[asked]

    # Jobs.
    def _job(self, kind: str, project_id: str | None, work):
        """Runs `work` under a job: its states are rows, the newest of which is its status; `cancel_job` stops its stages."""
        job_id = uuid.uuid4().hex
        say = lambda status, error=None: self._say(job_id, kind, project_id, status, error)
        say("PROCESSING")
        self.spark.addTag(f"job-{job_id}")
        try:
            out = work()
        except Exception as e:
            if self._job_row(job_id)["status"] != "CANCELLED":
                say("FAILED", str(e)[:500])
            raise
        finally:
            self.spark.removeTag(f"job-{job_id}")
        say("COMPLETED")
        return out

    def _say(self, job_id: str, kind: str, project_id: str | None, status: str, error: str | None = None) -> None:
        self._add("jobs", project_id or "", self.spark.createDataFrame([(job_id, kind, project_id, status, time.time(), error)], SCHEMAS["jobs"]))

    def _latest(self) -> DataFrame:
        return catalog.newest(self.table("jobs"), ["job_id"], [F.desc("at"), F.desc("status")])

    def _job_row(self, job_id: str) -> dict | None:
        row = self.table("jobs").where(F.col("job_id") == job_id).orderBy(F.desc("at")).first()
        return row.asDict() if row else None

    def list_jobs(self, limit: int = 1000) -> list[dict]:
        """The newest jobs with their last status."""
        return [r.asDict() for r in self._latest().orderBy(F.desc("at"), "job_id").limit(limit).collect()]

    def cancel_job(self, job_id: str) -> bool:
        """Marks a job that has not ended and stops what it runs in this session; true if it was there."""
        row = self._job_row(job_id)
        if row is None or row["status"] in DONE:
            return False
        self._say(job_id, row["kind"], row["project_id"], "CANCELLED")
        self.spark.interruptTag(f"job-{job_id}")
        return True

    def fail_stale_jobs(self, error: str = "stale") -> int:
        """Jobs that an earlier process left open become failed; how many."""
        open_jobs = cut(self._latest().where(~F.col("status").isin(*DONE)))
        for part in [r[0] for r in open_jobs.select(F.coalesce("project_id", F.lit(""))).distinct().collect()]:  # a row per project
            mine = open_jobs.where(F.coalesce("project_id", F.lit("")) == part)
            self._add("jobs", part, mine.withColumns({"status": F.lit("FAILED"), "at": F.lit(time.time()), "error": F.lit(error)}))
        return open_jobs.count()

    def prune_jobs(self, max_age_s: float = 30 * 86_400, max_rows: int = 1000) -> int:
        """Drops jobs older than an age, and all but the newest; how many."""
        last = self._latest()
        keep = cut(catalog.keep_newest(last, "at", "job_id", max_rows, F.lit(time.time() - max_age_s)).select("job_id"))
        gone = last.join(keep, "job_id", "left_anti").count()
        if gone:
            for part in {p for p, _ in self._tables["jobs"].entries(self._tables["jobs"].version())}:
                self._tables["jobs"].change(part, lambda old: None if old is None else old.join(keep, "job_id", "left_semi"))
        return gone

    # Reading directories.
    def _listed(self, directory: str) -> DataFrame:
        return sources.supported(sources.listing(self.spark, directory, self.ignore), extensions=TEXT_EXTENSIONS + DOCUMENTS)

    def _read(self, project_id: str, listed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(files, chunks, nodes) of listed files; each is read once."""
        office = extension(F.col("rel_path")).isin(*DOCUMENTS)
        found = cut(sources.texts(listed.where(~office)))
        papers = sources.contents(listed.where(office)).withColumn("content_hash", F.sha2("content", 256))
        papers = cut(papers)
        meta = found.drop("text").unionByName(papers.drop("content"))
        meta = meta.select(F.lit(project_id).alias("project_id"), F.col("rel_path").alias("file_path"), "mtime_ns", "size_bytes", "content_hash")
        if listed.count() - meta.count() >= max(5, math.ceil(0.1 * listed.count())):
            raise RuntimeError("too many files failed to be read")
        w = found.select(F.col("rel_path").alias("file_path"), F.explode(T.window_lines(F.col("text"), self.target, self.overlap)).alias("w")).select("file_path", "w.*")
        # Lines: the breaks before a window are those that all windows before it skip.
        over = Window.partitionBy("file_path").orderBy("chunk_index")
        start = 1 + F.max("lead").over(over) + F.sum("skipped").over(over) - F.col("skipped")
        chunks = w.select("file_path", "chunk_index", "content", F.lit("file").alias("type"), F.lit(None).cast("int").alias("page"), start.cast("int").alias("start_line"), (start + F.col("inside")).cast("int").alias("end_line"))
        pages = documents.ingest_units(documents.units(papers), self.target, self.overlap)
        pdf = F.lower("rel_path").endswith(".pdf")
        none = F.lit(None).cast("int")
        chunks = chunks.unionByName(pages.select(F.col("rel_path").alias("file_path"), "chunk_index", "content", F.when(pdf, "pdf_page").otherwise("docx").alias("type"), F.when(pdf, F.col("unit") + 1).alias("page"), none.alias("start_line"), none.alias("end_line")))
        rows = chunks.select(
            F.lit(project_id).alias("project_id"), T.make_id(F.lit(project_id), F.col("file_path"), F.coalesce("page", F.lit(0)), F.col("chunk_index"), F.col("content")).alias("chunk_id"), "file_path", "content",
            T.token_count(F.col("content")).alias("token_count"), F.to_json(F.struct("type", F.col("file_path").alias("item_name"), "chunk_index", "page")).alias("metadata"), "start_line", "end_line",
        )
        symbols = graph.extract_symbols(found.select(F.col("rel_path").alias("file_path"), F.substring("text", 1, 512 * 1024).alias("text")), "file_path", "text", extractor=self.extractor)
        nodes = symbols.select(F.lit(project_id).alias("project_id"), F.concat_ws(":", "file_path", "node_type", "name").alias("node_id"), "node_type", "name", "file_path", "start_line", "end_line").dropDuplicates(["node_id"])
        return cut(meta), rows.dropDuplicates(["chunk_id"]), nodes

    def _embedded(self, rows: DataFrame) -> DataFrame:
        """Rows with a vector of their content: from the memo where it has one of this model and length, else embedded once and remembered."""
        rows = cut(rows.withColumn("__hash", F.sha2("content", 256)))
        memo = self.table("embedding_cache", self.model).where(vector.usable(F.col("embedding"), self.dim)).groupBy(F.col("content_hash").alias("__hash")).agg(F.max_by("embedding", "created_at").alias("vector"))
        texts = rows.where("content is not null").groupBy("__hash").agg(F.first("content").alias("content"))
        fresh = cut(texts.join(memo, "__hash", "left_anti").select("__hash", self.embed("content").alias("vector")))
        if not fresh.isEmpty():
            self._add("embedding_cache", self.model, fresh.select(F.col("__hash").alias("content_hash"), F.lit(self.model).alias("model_name"), F.col("vector").alias("embedding"), F.lit(time.time()).alias("created_at")))
        known = memo.join(rows.select("__hash").distinct(), "__hash", "left_semi").unionByName(fresh)
        return rows.join(known, "__hash", "left").drop("__hash")

    def prune_cache(self, max_age_s: float | None = None, max_rows: int | None = None, model: str | None = None) -> int:
        """Drops remembered vectors older than an age, and all but the newest of a model; how many."""
        gone, t = 0, self._tables["embedding_cache"]
        for part in {p for p, _ in t.entries(t.version()) if model in (None, p)}:
            old = self.table("embedding_cache", part)
            since = F.lit(time.time() - max_age_s) if max_age_s is not None else None
            keep = cut(catalog.keep_newest(old, "created_at", "content_hash", max_rows, since))
            gone += old.count() - keep.count()
            t.change(part, lambda was: None if was is None else catalog.keep_newest(was, "created_at", "content_hash", max_rows, since))
        return gone

    def _store(self, project_id: str, new: DataFrame, stale: DataFrame | None = None) -> None:
        """Adds chunks and their postings and takes out those of `stale`; a chunk that is in both stays as it was."""
        new = cut(new)
        ids = new.select("chunk_id")
        old = self.table("chunks", project_id)
        gone = (stale if stale is not None else old.select("chunk_id").limit(0)).join(ids, "chunk_id", "left_anti")
        gone = cut(gone.select("chunk_id").distinct())
        fresh = cut(self._embedded(new.join(old.select("chunk_id"), "chunk_id", "left_anti")).withColumn("access_count", F.lit(0)))

        def chunks(was: DataFrame) -> DataFrame:
            top = was.agg(F.coalesce(F.max("internal_id"), F.lit(0))).first()[0]
            add = catalog.numbered(fresh.join(was.select("chunk_id"), "chunk_id", "left_anti"), ["file_path", "chunk_id"], "internal_id", top)
            return was.join(gone, "chunk_id", "left_anti").select(*was.columns).unionByName(add.select(*was.columns), allowMissingColumns=True)

        self._change("chunks", project_id, chunks)
        post = cut(fts.postings(fresh, "chunk_id", "content", ["project_id"]))
        out = gone.unionByName(fresh.select("chunk_id"))
        self._change("postings", project_id, lambda was: was.join(out, "chunk_id", "left_anti").select(*was.columns).unionByName(post.select(*was.columns)).repartitionByRange("term").sortWithinPartitions("term"))
        sums = fts.totals(self.table("chunks", project_id), "content", ["project_id"])
        self._change("text_totals", project_id, lambda was: sums)

    def _stats(self, project_id: str) -> None:
        c = self.table("chunks", project_id).agg(F.count("*"), F.coalesce(F.sum("token_count"), F.lit(0))).first()
        n = self.table("file_metadata", project_id).count()
        self._change("projects", project_id, lambda p: p.withColumns({"chunk_count": F.lit(c[0]), "total_tokens": F.lit(c[1]), "file_count": F.lit(n), "updated_at": F.lit(time.time())}))

    # Projects.
    def index_project(self, directory: str, project_name: str, project_type: str = "code") -> str:
        """Indexes a directory and gives the project's id; a directory that is indexed already is updated."""
        if not sources.allowed(directory, self.roots):
            raise PermissionError(f"{directory} is not in an allowed root")
        if not project_name.strip() or len(project_name) > 200 or any(unicodedata.category(c) in ("Cc", "Cf", "Zl", "Zp") for c in project_name):
            raise ValueError("a project's name has 1 to 200 printable characters")
        real = os.path.realpath(directory)
        known = self.table("projects").where(F.col("directory") == real).first()
        if known:
            self.update_project(known["project_id"])
            return known["project_id"]
        name = "_".join("".join(c if c.isascii() and c.isalnum() else " " for c in project_name.lower()).split()) or "project"
        project_id = f"{name}_{time.time_ns()}_{uuid.uuid4().hex[:8]}"

        def work() -> str:
            listed = cut(self._listed(real))
            if not sources.project_limits(listed).first()["within"]:
                raise ValueError("the directory is over the limits of a project")
            meta, rows, nodes = self._read(project_id, listed)
            rows = cut(rows)
            if rows.isEmpty():
                raise ValueError("No indexable content")
            row = self.spark.createDataFrame([(project_id, project_name, project_type, real, json.dumps({"embedding_dim": self.dim, "model": self.model}), 0, 0, 0, time.time())], SCHEMAS["projects"])
            self._store(project_id, rows)
            self._change("file_metadata", project_id, lambda was: meta)
            self._change("graph_nodes", project_id, lambda was: nodes)
            self._change("projects", project_id, lambda was: row)
            self._stats(project_id)
            return project_id

        return self._job("index_project", project_id, work)

    def update_project(self, project_id: str) -> dict:
        """Brings a project up to its directory: only files whose time or size differ are read, only those with other content cut anew.

        Chunks that are the same stay, virtual files stay, and a file that can't be read keeps its old rows.
        """
        p = self.project_info(project_id)
        if json.loads(p["metadata"] or "{}").get("model", self.model) != self.model:
            raise ValueError("the project was embedded by another model")
        if not sources.allowed(p["directory"], self.roots) or os.path.realpath(p["directory"]) != p["directory"]:
            raise PermissionError(f"{p['directory']} is not where it was or not in an allowed root")

        def work() -> dict:
            listed = cut(self._listed(p["directory"]))
            virtual = F.col("file_path").startswith("vfs://")
            old = cut(self.table("file_metadata", project_id).where(~virtual))
            same = old.select(F.col("file_path").alias("rel_path"), "mtime_ns", "size_bytes")
            meta, rows, nodes = self._read(project_id, cut(listed.join(same, ["rel_path", "mtime_ns", "size_bytes"], "left_anti").select(*listed.columns)))
            was = old.select("file_path", F.col("content_hash").alias("was"))
            changed = cut(meta.join(was, "file_path", "left").where(F.col("was").isNull() | (F.col("was") != F.col("content_hash"))).select("file_path", F.col("was").isNull().alias("fresh")))
            deleted = cut(old.join(listed.select(F.col("rel_path").alias("file_path")), "file_path", "left_anti").select("file_path"))
            out = cut(changed.select("file_path").unionByName(deleted))
            news = changed.select("file_path")
            kept = lambda df: df.join(out, "file_path", "left_anti").select(*df.columns)
            stale = cut(self.table("chunks", project_id).join(out, "file_path", "left_semi").select("chunk_id"))
            n = changed.agg(F.count("*"), F.count(F.when(~F.col("fresh"), 1))).first()
            gone = deleted.count()
            if n[0] or gone:
                self._store(project_id, rows.join(news, "file_path", "left_semi"), stale)
                self._change("graph_nodes", project_id, lambda g: kept(g).unionByName(nodes.join(news, "file_path", "left_semi").select(*g.columns)))
            touched = meta.select("file_path")
            self._change("file_metadata", project_id, lambda f: f.join(deleted, "file_path", "left_anti").join(touched, "file_path", "left_anti").select(*f.columns).unionByName(meta.select(*f.columns)))
            self._stats(project_id)
            return {"added": n[0], "deleted": gone + n[1]}

        return self._job("update_project", project_id, work)

    def list_projects(self) -> list[dict]:
        return [r.asDict() for r in self.table("projects").orderBy(F.desc("updated_at"), "project_id").collect()]

    def project_info(self, project_id: str) -> dict:
        row = self.table("projects", project_id).first()
        if row is None:
            raise KeyError(f"Project not found: {project_id}")
        return row.asDict()

    def delete_project(self, project_id: str) -> dict:
        """Takes out a project with everything it owns; remembered vectors stay, as other projects may share them."""
        self.project_info(project_id)
        for name in (*OWNED, "projects"):
            self._change(name, project_id, lambda was: None)
        return {"deleted": project_id}

    def project_health(self, project_id: str) -> dict:
        p = self.project_info(project_id)
        n = self.table("chunks", project_id).agg(F.count("*").alias("chunks"), F.count("vector").alias("vectors"), F.countDistinct("internal_id").alias("numbers")).first().asDict()
        words = self.table("chunks", project_id).where(F.size(T.tokens(F.col("content"))) > 0).count()
        n["indexed"] = self.table("postings", project_id).select("chunk_id").distinct().count()
        return n | {"healthy": n["chunks"] == n["vectors"] == n["numbers"] == p["chunk_count"] and n["indexed"] == words}

    def repair_project(self, project_id: str) -> dict:
        """Vectors that lack are made again, then the postings and the counts."""

        def vectors(c: DataFrame) -> DataFrame:
            good = vector.usable(F.col("vector"), self.dim)
            return c.where(good).unionByName(self._embedded(c.where(~good).drop("vector")).select(*c.columns))

        self._change("chunks", project_id, vectors)
        c = self.table("chunks", project_id)
        self._change("postings", project_id, lambda was: fts.postings(c, "chunk_id", "content", ["project_id"]).select(*was.columns).repartitionByRange("term").sortWithinPartitions("term"))
        self._change("text_totals", project_id, lambda was: fts.totals(c, "content", ["project_id"]))
        self._stats(project_id)
        return self.project_health(project_id)

    # Search.
    def _vector(self, text: str) -> list[float]:
        return list(self.spark.createDataFrame([(text,)], "t string").select(self.embed("t")).first()[0])

    def _words(self, project_id: str, query: str, limit: int, mode: str) -> DataFrame:
        """(chunk_id, score) from the stored postings; document frequencies and lengths are those of all projects."""
        return fts.best(self.table("postings"), self.table("text_totals"), "chunk_id", query, limit, mode, ["project_id"], F.col("project_id") == project_id)

    def search_memory(self, query: str, project_id: str, max_results: int = 10, use_mmr: bool = True, fts_mode: str = "strict", max_content_chars: int = 1200) -> dict:
        """Lexical and vector search fused by reciprocal ranks, with bonuses, diversified, and with the rules of its files."""
        if len(query) > MAX_QUERY_CHARS or len(query.split()) > MAX_QUERY_TOKENS:
            raise ValueError("the query is too long")
        asked = (project_id, query, max_results, use_mmr, fts_mode, max_content_chars)
        if asked in self._answers and time.monotonic() - self._answers[asked][0] < CACHE_SECONDS:
            self._answers.move_to_end(asked)
            return self._answers[asked][1]
        k = max(1, min(max_results, 50))
        c = self.table("chunks", project_id)
        lex = fusion.ranked(self._words(project_id, query, 200, fts_mode), "score", "chunk_id", "lex_rank")
        vec = vector.knn_arrow(c, "chunk_id", "vector", self._vector(query), 200)
        fused = fusion.rrf(lex, vec, "chunk_id").join(c.select("chunk_id", F.get_json_object("metadata", "$.type").alias("kind")), "chunk_id")
        top = cut(fusion.boost(fused, "kind").orderBy(F.desc("score"), "chunk_id").limit(max(k, 50)))
        order = top.select("chunk_id", "score")
        if use_mmr and k > 1:
            pool = order.orderBy(F.desc("score"), "chunk_id").limit(max(5 * k, k)).join(c.select("chunk_id", "vector"), "chunk_id").where("vector is not null")
            order = order.join(fusion.mmr(pool, "chunk_id", "vector", "score", k), "chunk_id", "left")
        else:
            order = order.withColumn("mmr_pos", F.lit(None).cast("int"))
        best = cut(order.orderBy(F.asc_nulls_last("mmr_pos"), F.desc("score"), "chunk_id").limit(k).join(c, "chunk_id"))  # k rows
        rows = graph.apply_rules(best, self.table("repo_rules", project_id), "file_path", "content").withColumn("content", T.trim_content(F.col("content"), max_content_chars))
        found = [r.asDict() for r in rows.select("chunk_id", "score", "mmr_pos", "token_count", "metadata", "content").collect()]
        found.sort(key=lambda r: (r["mmr_pos"] is None, r["mmr_pos"] or 0, -r["score"], r["chunk_id"]))
        self._log(project_id, query, [r["chunk_id"] for r in found])
        out = {"query": query, "project_id": project_id, "vector_enabled": True, "count": len(found), "results": [{"id": r["chunk_id"], **{x: r[x] for x in ("score", "token_count", "metadata", "content")}} for r in found]}
        self._answers[asked] = (time.monotonic(), out)
        while len(self._answers) > CACHE_ITEMS:
            self._answers.popitem(last=False)
        self._trigger(project_id)
        return out

    def _log(self, project_id: str, query: str, ids: list[str]) -> None:
        row = self.spark.createDataFrame([(uuid.uuid4().hex, project_id, query, ids)], "session_id string, project_id string, query string, result_chunk_ids array<string>").withColumn("created_at", F.current_timestamp())
        self._add("search_sessions", project_id, row)

    def _trigger(self, project_id: str) -> None:
        """A cycle of insights after enough searches, where that is switched on."""
        if self._auto is None:
            return
        every, gap, per_day, pairs = self._auto
        if self._triggers.setdefault(project_id, mining.TriggerState(every, gap, per_day)).see(time.time()):
            self.dream_project(project_id, pairs)

    def accesses(self, project_id: str) -> DataFrame:
        """(chunk_id, access_count): a chunk's own count and the searches of the log that gave it."""
        plus = self.table("search_sessions", project_id).select(F.explode(F.array_distinct("result_chunk_ids")).alias("chunk_id")).where("chunk_id is not null").groupBy("chunk_id").agg(F.count("*").alias("plus"))
        return self.table("chunks", project_id).select("chunk_id", "access_count").join(plus, "chunk_id", "left").select("chunk_id", (F.coalesce("access_count", F.lit(0)) + F.coalesce("plus", F.lit(0))).alias("access_count"))

    def prune_sessions(self, project_id: str, max_age_s: float | None = None, max_rows: int | None = None) -> int:
        """Drops a project's searches older than an age, and all but the newest; what they gave stays counted. How many."""
        old = self.table("search_sessions", project_id)
        since = F.current_timestamp() - F.make_dt_interval(secs=F.lit(float(max_age_s))) if max_age_s is not None else None
        keep = cut(catalog.keep_newest(old, "created_at", "session_id", max_rows, since).select("session_id"))
        gone = cut(old.join(keep, "session_id", "left_anti"))
        n = gone.count()
        if n:
            plus = gone.select(F.explode(F.array_distinct("result_chunk_ids")).alias("chunk_id")).groupBy("chunk_id").agg(F.count("*").alias("plus"))
            self._change("chunks", project_id, lambda c: c.join(plus, "chunk_id", "left").withColumn("access_count", F.coalesce("access_count", F.lit(0)) + F.coalesce("plus", F.lit(0))).select(*c.columns))
            ids = gone.select("session_id")
            self._change("search_sessions", project_id, lambda s: s.join(ids, "session_id", "left_anti").select(*s.columns))
        return n

    def get_chunk(self, project_id: str, chunk_id: str, max_content_chars: int = 1200) -> dict | None:
        row = self.table("chunks", project_id).where(F.col("chunk_id") == chunk_id).withColumn("content", T.trim_content(F.col("content"), max_content_chars)).drop("vector").first()
        if row is None:
            return None
        given = self.table("search_sessions", project_id).where(F.array_contains("result_chunk_ids", chunk_id)).count()
        return row.asDict() | {"access_count": (row["access_count"] or 0) + given}

    # The code graph.
    def query_graph_nodes(self, project_id: str, node_type: str = "", name_pattern: str = "", file_path: str = "", limit: int = 100) -> list[dict]:
        return [r.asDict() for r in graph.query_nodes(self.table("graph_nodes", project_id), node_type, name_pattern, file_path, limit).collect()]

    def find_references(self, project_id: str, node_id: str) -> list[dict]:
        """All edges of one node, by direction and peer."""
        one = self.spark.createDataFrame([(node_id,)], "node_id string")
        found = graph.neighbours(self.table("graph_edges", project_id), self.table("graph_nodes", project_id), one)
        return [r.asDict() for r in found.orderBy("direction", "peer_id", "edge_type", "peer_name").collect()]

    def find_symbol_references(self, symbol_name: str, project_id: str) -> dict:
        """Definitions, their references, and all files coupled with those of the definitions."""
        nodes, edges = self.table("graph_nodes", project_id), self.table("graph_edges", project_id)
        found = cut(graph.definitions(nodes, symbol_name))
        refs = graph.references(found, edges, nodes)
        near = found.select(F.concat_ws(":", F.lit(project_id), "file_path", F.lit("FILE"), "file_path").alias("source_id")).distinct().join(edges, "source_id").select("source_id", "target_id").orderBy("source_id", "target_id")
        return {"definitions": [r.asDict() for r in found.collect()], "references": [r.asDict() for r in refs.collect()], "coupled_files": [r.asDict() for r in near.collect()]}

    def graph_search(self, project_id: str, query: str, max_results: int = 10, symbol_boost: float = 0.03) -> list[dict]:
        """A search in which chunks of files that define a symbol of the query are lifted."""
        k = max(1, min(max_results, 50))
        c = self.table("chunks", project_id).select("chunk_id", "file_path", "content")
        files = graph.symbol_files(self.spark.createDataFrame([(0, query)], "id int, q string"), "id", "q", self.table("graph_nodes", project_id)).select("file_path")
        hits = self._words(project_id, query, min(50, 3 * k), "any").join(c, "chunk_id")
        rows = graph.lifted(hits, files, symbol_boost).select("chunk_id", "file_path", "graph_match", "score", T.trim_content(F.col("content")).alias("content"))
        return [r.asDict() for r in rows.orderBy(F.desc("score"), "chunk_id").limit(k).collect()]

    def analyze_error_stack(self, traceback: str, project_id: str) -> dict:
        root = self.project_info(project_id)["directory"] + "/"
        found = graph.frames(self.spark.createDataFrame([(0, traceback)], "id int, t string"), "id", "t").withColumn("file", F.when(F.col("file").startswith(root), F.substring(F.col("file"), F.lit(len(root) + 1), F.length("file"))).otherwise(F.col("file")))
        c = self.table("chunks", project_id)
        spans = c.select(F.col("file_path").alias("file"), "start_line", "end_line", "chunk_id", "internal_id")
        rows = graph.frame_context(found, spans, ["pos"]).join(c.select("chunk_id", F.substring("content", 1, 1000).alias("content")), "chunk_id", "left").orderBy("pos")
        out = [r.asDict() for r in rows.collect()]
        return {"parsed_frames": [{x: r[x] for x in ("file", "line", "language")} for r in out], "code_context": out, "total_frames": len(out)}

    # Overviews and the memory bank.
    def get_codebase_overview(self, project_id: str) -> dict:
        f, c = self.table("file_metadata", project_id), self.table("chunks", project_id)
        dirs = f.where(F.instr("file_path", "/") > 0).groupBy(F.substring_index("file_path", "/", 1).alias("dir")).count().orderBy(F.desc("count"), "dir").limit(25)
        exts = f.where(F.instr("file_path", ".") > 0).groupBy(F.lower(F.expr("substring(file_path, instr(file_path, '.') + 1)")).alias("ext")).count().orderBy(F.desc("count"), "ext").limit(10)
        new = f.orderBy(F.desc("mtime_ns"), "file_path").limit(5)
        bank = f.where(F.col("file_path").startswith("vfs://memory/")).count()
        out = {"files": f.count(), "chunks": c.count(), "directories": {r["dir"]: r["count"] for r in dirs.collect()}, "languages": {r["ext"]: r["count"] for r in exts.collect()}, "newest": [r["file_path"] for r in new.collect()]}
        hints = []
        if not bank:
            hints.append("The memory bank is empty: update_memory_bank writes a section.")
        if not self.table("git_commits", project_id).take(1):
            hints.append("No history is indexed: index_git_history reads it.")
        return out | {"hints": hints}

    def update_memory_bank(self, project_id: str, section: str, content: str) -> dict:
        """Writes a section as one virtual file; one that is there is replaced."""
        name = "".join(ch for ch in section if ch.isalnum() or ch in "_-")
        if not name:
            raise ValueError("the section has no name")
        path = f"vfs://memory/{name}.md"
        meta = json.dumps({"type": "memory_bank", "section": name, "item_name": path})
        row = self.spark.createDataFrame([(project_id, path, content, meta)], "project_id string, file_path string, content string, metadata string")
        # The content is part of the id, so that a section that says something else is another chunk.
        self._virtual(project_id, path, row.withColumn("chunk_id", T.make_id(F.lit("memory"), F.lit(project_id), F.lit(path), F.col("content"))))
        return {"section": name, "file_path": path}

    def _virtual(self, project_id: str, path: str, rows: DataFrame, keep: bool = False) -> None:
        """(chunk_id, content, metadata) rows as the chunks of a virtual file, in the place of those it had or, with `keep`, beside them."""
        none = F.lit(None).cast("int")
        rows = cut(rows.select(F.lit(project_id).alias("project_id"), "chunk_id", F.lit(path).alias("file_path"), "content", T.token_count(F.col("content")).alias("token_count"), "metadata", none.alias("start_line"), none.alias("end_line")).dropDuplicates(["chunk_id"]))
        stale = None if keep else self.table("chunks", project_id).where(F.col("file_path") == path).select("chunk_id")
        self._store(project_id, rows, stale)
        held = self.table("chunks", project_id).where(F.col("file_path") == path)
        file = held.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("size_bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.sha2("content", 256))), ""), 256).alias("content_hash"))
        file = file.select(F.lit(project_id).alias("project_id"), F.lit(path).alias("file_path"), F.lit(time.time_ns()).alias("mtime_ns"), "size_bytes", "content_hash")
        file = cut(file)
        self._change("file_metadata", project_id, lambda f: f.where(F.col("file_path") != path).unionByName(file.select(*f.columns)))
        self._stats(project_id)

    def get_project_context(self, project_id: str) -> dict:
        """The overview and every section of the memory bank, the chunks of each joined in order."""
        c = self.table("chunks", project_id).where(F.col("file_path").startswith("vfs://memory/"))
        name = F.replace(F.replace("file_path", F.lit("vfs://memory/"), F.lit("")), F.lit(".md"), F.lit(""))
        whole = c.where("content <> ''").groupBy(name.alias("section")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("internal_id", "content"))), lambda x: x["content"]), "\n\n").alias("content"))
        return self.get_codebase_overview(project_id) | {"memory": {r["section"]: r["content"] for r in whole.orderBy("section").collect()}}

    # History.
    def index_git_history(self, project_id: str, log: str | None = None, limit: int = 500) -> dict:
        """Reads `git log` output (marker, hash|author|time|subject, name-status, patch), or the log of the project's own repository: the newest `limit` commits that say something.

        Each message becomes a chunk with a vector, so that searches meet it.
        """
        if log is None:
            log = sources.run_git_log(self.project_info(project_id)["directory"], f"{self.path}/git-log-{uuid.uuid4().hex}.txt", limit)
        parsed = history.parse_sections(sources.git_log(self.spark, log), "section").withColumn("project_id", F.lit(project_id))
        new = cut(parsed.where(T.is_meaningful(F.col("message"))).orderBy(F.desc("timestamp"), "commit_hash").limit(limit))
        rows = cut(history.parse_diffs(new).select(T.make_id(F.col("commit_hash"), F.col("file_path")).alias("id"), "commit_hash", F.lit(project_id).alias("project_id"), "file_path", "change_type", "diff_content").dropDuplicates(["id"]))
        name = T.make_id(F.lit("commit"), F.lit(project_id), F.col("commit_hash"))
        commits = cut(new.dropDuplicates(["commit_hash"]).select("commit_hash", "project_id", "author", "timestamp", "message", name.alias("embedding_uuid")))
        tags = cut(commits.select("project_id", "commit_hash", F.explode(T.commit_tags(F.col("message"))).alias("tag")))
        said = F.to_json(F.struct(F.lit("git_commit").alias("type"), "commit_hash", "author", "timestamp", F.lit(COMMITS).alias("file_path")))
        self._virtual(project_id, COMMITS, commits.select(F.col("embedding_uuid").alias("chunk_id"), F.col("message").alias("content"), said.alias("metadata")), keep=True)
        self._change("git_commits", project_id, lambda old: catalog.upsert(old, commits, ["commit_hash"], ["project_id"]))
        self._change("git_diffs", project_id, lambda old: catalog.upsert(old, rows, ["id"]))
        self._change("git_tags", project_id, lambda old: catalog.insert_ignore(old, tags, ["commit_hash", "tag"]))
        return {"commits": commits.count(), "diffs": rows.count(), "tags": tags.count()}

    def search_history(self, query: str, project_id: str, file_filter: str | None = None, limit: int = 5) -> dict:
        """Commits by message and by stored vector, fused, with their diffs and tags."""
        c = self.table("git_commits", project_id)
        vectors = self.table("chunks", project_id).where(F.col("file_path") == COMMITS).select(F.col("chunk_id").alias("embedding_uuid"), "vector")
        rows = history.search(self.spark, c, self.table("git_diffs", project_id), self.table("git_tags", project_id), c.join(vectors, "embedding_uuid").select("commit_hash", "vector"), query, self._vector(query), file_filter, limit)
        found = [r.asDict(True) for r in rows.orderBy(F.desc("score"), "commit_hash").collect()]
        return {"query": query, "related_commits": found, "total_commits": len(found), "search_mode": "hybrid"}

    def analyze_temporal_couplings(self, project_id: str, min_frequency: int = 5, limit: int = 50, inject_edges: bool = True) -> dict:
        c, x = self.table("git_commits", project_id), self.table("git_diffs", project_id)
        top = cut(history.couplings(x, c, min_frequency).orderBy(F.desc("frequency"), "file_a", "file_b").limit(limit))
        recent = history.coupling_commits(top, x, c).groupBy("project_id", "file_a", "file_b").agg(F.sort_array(F.collect_list(F.struct("rn", "commit_hash", "message"))).alias("commits"))
        rows = [r.asDict(True) for r in top.join(recent, ["project_id", "file_a", "file_b"], "left").orderBy(F.desc("frequency"), "file_a", "file_b").collect()]
        if inject_edges and rows:
            file = lambda p: f"{project_id}:{p}:FILE:{p}"
            new = self.spark.createDataFrame([(project_id, file(r[a]), file(r[b]), "temporal_coupling") for r in rows for a, b in (("file_a", "file_b"), ("file_b", "file_a"))], SCHEMAS["graph_edges"])
            self._change("graph_edges", project_id, lambda old: catalog.upsert(old, new, ["project_id", "source_id", "target_id"]))
        return {"couplings": rows, "edges_injected": 2 * len(rows) if inject_edges else 0}

    def analyze_reverts(self, project_id: str) -> dict:
        c, x = self.table("git_commits", project_id), self.table("git_diffs", project_id)
        pairs = cut(history.revert_pairs(c))
        rules = cut(history.revert_rules(pairs, c, x))
        self._change("repo_rules", project_id, lambda old: catalog.upsert(old, rules.select("rule_id", "project_id", "file_pattern", "rule_text", "priority"), ["rule_id"]))
        return {"reverts_found": pairs.count(), "rules_generated": rules.count(), "previews": [r["rule_text"][:200] for r in rules.orderBy("rule_id").limit(3).collect()]}

    def analyze_file_coding_style(self, project_id: str, file_path: str, diff_limit: int = 10) -> dict:
        x = self.table("git_diffs", project_id).where(F.col("file_path") == file_path).join(self.table("git_commits", project_id).select("commit_hash", "timestamp", "message"), "commit_hash").orderBy(F.desc("timestamp"), "commit_hash").limit(diff_limit).collect()
        if not x:
            return {"style_guide": None, "analyzed_commits": [], "file_path": file_path}
        prompt = f"Recent changes to {file_path}:\n" + "\n".join(f"Commit: {r['commit_hash'][:8]}\nMessage: {r['message']}\nDiff:\n{(r['diff_content'] or '')[:2000]}" for r in x)
        said = self.spark.createDataFrame([(prompt,)], "prompt string").select(self.generate("prompt").alias("said")).first()[0]
        return {"style_guide": said, "analyzed_commits": [r["commit_hash"] for r in x], "file_path": file_path}

    # Dreaming.
    def dream_project(self, project_id: str, max_pairs: int = 10) -> dict:
        """Insights for the pairs of chunks that come back together most often and that no insight covers yet.

        Prompts are built and answered in one batch; each context has an equal part of the window.
        """
        c = self.table("chunks", project_id)
        files = c.select("project_id", "chunk_id", "file_path")
        known = c.where(F.get_json_object("metadata", "$.type") == "insight").select(F.get_json_object("metadata", "$.source_chunks[0]").alias("chunk_a"), F.get_json_object("metadata", "$.source_chunks[1]").alias("chunk_b"))
        top = mining.co_retrieved(self.table("search_sessions", project_id), files, known).orderBy(F.desc("pair_count"), "chunk_a", "chunk_b").limit(max(1, min(max_pairs, MAX_PAIRS)))
        budget = max(64, int(CONTEXT_WINDOW * 0.75) // 2)
        short = T.truncate_tokens(F.col("content"), budget)
        a, b = c.select(F.col("chunk_id").alias("chunk_a"), short.alias("a")), c.select(F.col("chunk_id").alias("chunk_b"), short.alias("b"))
        both = top.join(a, "chunk_a").join(b, "chunk_b").where("trim(a) <> '' and trim(b) <> ''")
        prompt = F.concat(F.lit("Context A:\n"), "a", F.lit("\n\nContext B:\n"), "b", F.lit("\n\nInsight:"))
        said = cut(both.select("chunk_a", "chunk_b", F.trim(self.generate(prompt)).alias("content")).where(mining.says_something(F.col("content"))))
        meta = F.to_json(F.struct(F.lit("insight").alias("type"), F.array("chunk_a", "chunk_b").alias("source_chunks"), F.lit(INSIGHTS).alias("item_name")))
        made = said.count()
        if made:
            self._virtual(project_id, INSIGHTS, said.select(T.make_id(F.lit("insight"), F.lit(project_id), F.col("chunk_a"), F.col("chunk_b")).alias("chunk_id"), "content", meta.alias("metadata")), keep=True)
        return {"insights": made}

    def trigger_rem_cycle(self, project_id: str) -> dict:
        return self.dream_project(project_id)


def _batched(generate) -> Callable[[Column | str], Column]:
    """A column function of prompts, from one or from a plain function of one prompt."""
    if hasattr(generate, "returnType") or getattr(generate, "evalType", None) is not None:
        return generate

    import pandas as pd

    def run(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: None if p is None else generate(p))

    run.__annotations__ = {"prompts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")
