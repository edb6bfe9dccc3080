import glob
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsest import tools
from palimpsest.plans import base, catalog, history, incremental, text, vectors  # noqa: F401
from palimpsest.sources import files
from palimpsest.streaming import sessions
from palimpsest.tools import Memory

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    if v is None or v != v:
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(base.QUERIES) + ["p3_found"])
def test_query(spark, duck, name):
    got = (base.QUERIES | incremental.QUERIES)[name](spark, SF)
    sql = (base.ORACLE | incremental.ORACLE).get(name)
    rows = [r.asDict() for r in got.collect()]
    if sql:
        res = duck.execute(sql)
        cols = [c[0] for c in res.description]
        assert sorted(cols) == sorted(got.columns)
        want = sorted(str([norm(dict(zip(cols, r))[c]) for c in sorted(cols)]) for r in res.fetchall())
        assert sorted(str([norm(r[c]) for c in sorted(cols)]) for r in rows) == want


def test_sources(spark, tmp_path):
    root = tmp_path / "src+a (1)"
    for folder in ("src/node_modules", "pkg/.hidden/deep", ".github", "_private"):
        (root / folder).mkdir(parents=True)
    (root / "src/a.py").write_text("def f():\n    return 1\n")
    (root / "src/b.bin").write_bytes(b"\x00\xff")
    (root / "src/c.log").write_text("x")
    (root / "src/node_modules/d.js").write_text("x")
    (root / "pkg/__init__.py").write_text("")
    (root / "pkg/_util.py").write_text("u = 1")
    (root / "pkg/.hidden/deep/x.py").write_text("x = 1")
    (root / ".github/ci.yml").write_text("on: push")
    (root / "latin.txt").write_bytes("caf\u00e9 ol\u00e9".encode("latin-1"))
    (root / "link.py").symlink_to(root / "src/a.py")
    found = files.listing(spark, str(root))
    assert sorted(r.rel_path for r in found.collect()) == [".github/ci.yml", "latin.txt", "pkg/.hidden/deep/x.py", "pkg/__init__.py", "pkg/_util.py", "src/a.py", "src/b.bin"]
    texts = {r.rel_path: r.text for r in files.texts(files.supported(found)).collect()}
    assert texts["latin.txt"] == "caf ol" and texts["pkg/__init__.py"] == "" and len(texts) == 6
    chunks = {c.rel_path: (c.content, c.token_range) for c in files.ingest(files.supported(found)).collect()}
    assert chunks["src/a.py"] == ("def f():\n    return 1", "0-3") and chunks["pkg/_util.py"] == ("u = 1", "0-2") and "pkg/__init__.py" not in chunks
    assert {r.rel_path: bytes(r.content) for r in files.contents(found).collect()}["src/b.bin"] == b"\x00\xff"
    assert files.project_limits(found).first()["within"]
    assert files.allowed(str(root / "src"), [str(root)]) and not files.allowed("/etc", [str(root)]) and not files.allowed("/etc", [])
    assert files.listing(spark, str(root / "nowhere")).count() == 0 and files.listing(spark, f"file://{root}").count() == 7


def test_listing_of_many_directories_is_handed_on(spark, tmp_path, monkeypatch):
    for i in range(30):
        (tmp_path / f"d{i}/e/f").mkdir(parents=True)
        (tmp_path / f"d{i}/e/f/x.py").write_text("x")
        (tmp_path / f"d{i}/y.py").write_text("y")
    monkeypatch.setattr(files, "LISTED", 10)
    assert files.listing(spark, str(tmp_path)).select("rel_path").distinct().count() == files.listing(spark, str(tmp_path)).count() == 60


def test_files_that_change_or_vanish_give_no_row(spark, tmp_path):
    for n in "abc":
        (tmp_path / f"{n}.txt").write_text(n)
    found = files.listing(spark, str(tmp_path))
    (tmp_path / "a.txt").unlink()
    (tmp_path / "b.txt").write_text("longer")
    assert [r.rel_path for r in files.texts(found).collect()] == ["c.txt"]


def test_long_sections_are_capped_by_lines(spark, tmp_path):
    text = "h|a|1|s\n" + "\u00e9" * 40 + "\nshort\n"
    assert files.cap_section(text, 30) == "h|a|1|s\n" + files.SECTION_CUT + "short\n"
    assert files.cap_section(text, 1000) == text
    got = [r.section for r in files.capped(spark.createDataFrame([(text,), ("x",)], "section string"), 30).collect()]
    assert sorted(got) == sorted(["h|a|1|s\n" + files.SECTION_CUT + "short\n", "x"])


def test_log_of_a_repository(spark, tmp_path):
    import subprocess

    from palimpsest.operators import history

    repo = tmp_path / "repo"
    repo.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=Ann", "-c", "user.email=a@example.com", *a], check=True, capture_output=True)
    git("init", "-q")
    for i, text in enumerate(("one\n", "two\n")):
        (repo / "a b.txt").write_text(text)
        (repo / f"c{i}.py").write_text(text)
        git("add", "-A")
        git("commit", "-q", "-m", f"change number {i} | of two")
    log = files.run_git_log(str(repo), f"file://{tmp_path}/logs/x.txt")
    parsed = history.parse_sections(files.git_log(spark, log), "section")
    assert [(r.author, r.message) for r in parsed.orderBy("message").collect()] == [("Ann", "change number 0 | of two"), ("Ann", "change number 1 | of two")]
    rows = {(r.file_path, r.change_type) for r in history.parse_diffs(parsed).collect()}
    assert rows == {("a b.txt", "ADDED"), ("c0.py", "ADDED"), ("a b.txt", "MODIFIED"), ("c1.py", "ADDED")}
    with pytest.raises(RuntimeError):
        files.run_git_log(str(tmp_path), f"file://{tmp_path}/logs/y.txt")


def test_stored_index_equals_the_pass_over_texts(spark):
    from palimpsest.operators import fts
    from palimpsest.session import table

    docs = table(spark, SF, "documents")
    index, sums = fts.postings(docs, "doc_id", "text").cache(), fts.totals(docs, "text")
    for asked, mode in (("cache OR stream NOT the", "strict"), ("the ranking step", "phrase"), ("in_the of", "any"), ("!!!", "strict"), ("", "any"), ("the not", "any"), ("zzzzqq the", "any")):
        terms = fts.parse(asked, mode)
        want = {(r.doc_id, r.score) for r in fts.bm25(docs, "doc_id", "text", terms).collect()}
        assert {(r.doc_id, r.score) for r in fts.match(index, sums, "doc_id", terms).collect()} == want, asked
    few = spark.createDataFrame([("a", "x x x", "p"), ("b", None, "p"), ("c", "", "q"), ("d", "y X", "q")], "k string, t string, p string")
    rows = {(r.k, r.term): (r.tf, r.dl, r.positions) for r in fts.postings(few, "k", "t", ["p"]).collect()}
    assert rows == {("a", "x"): (3, 3, [0, 1, 2]), ("d", "x"): (1, 2, [1]), ("d", "y"): (1, 2, [0])}
    found = fts.best(fts.postings(few, "k", "t", ["p"]), fts.totals(few, "t", ["p"]), "k", "x", 5, "any", ["p"], F.col("p") == "q").collect()
    assert [r.k for r in found] == ["d"] and fts.totals(few, "t").first().docs == 4


def test_streams_equal_batch(spark, tmp_path):
    rows = base.sessions(spark, "/root/testdata/sf0.01").where("project_id is not null and created_at is not null")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = sessions.trigger_stream(stream, every=5).writeStream.format("memory").queryName("fired").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    from palimpsest.operators.mining import auto_trigger

    want = {(r.project_id, r.fired_at) for r in auto_trigger(rows, every=5).collect()}
    assert {(r.project_id, r.fired_at) for r in spark.table("fired").collect()} == want and want
    q = sessions.windowed_pairs(stream, late="1000 days").writeStream.format("memory").queryName("pairs").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    ids = F.array_sort(F.array_compact(F.array_distinct("result_chunk_ids")))
    n = rows.select(F.size(ids).alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0]
    assert spark.table("pairs").agg(F.sum("pair_count")).first()[0] == n


def test_windowed_pairs_keep_late_rows(spark, tmp_path):
    rows = base.sessions(spark, "/root/testdata/sf0.01").where("project_id is not null and created_at is not null").cache()
    at = F.col("created_at").cast("double")
    cuts = rows.select(at.alias("at")).approxQuantile("at", [0.33, 0.66], 0.01)
    # The newest rows come first, the oldest last, each in a batch of its own.
    for i, part in enumerate((at > cuts[1], (at > cuts[0]) & (at <= cuts[1]), at <= cuts[0])):
        rows.where(part).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
    (tmp_path / "in").mkdir()
    for i in range(3):
        (f,) = (tmp_path / f"part{i}").glob("*.parquet")
        f.rename(tmp_path / f"in/{i}.parquet")
        os.utime(tmp_path / f"in/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got, batches = {}, []

    def take(df, n):
        batches.append(n)
        got.update({tuple(r)[:4]: r.pair_count for r in df.collect()})

    q = sessions.windowed_pairs(stream).writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r)[:4]: r.pair_count for r in sessions.windowed_pairs(rows).collect()}
    print("pairs", sum(got.values()), "of", sum(want.values()))
    assert got == want and want and len(batches) >= 3


@pytest.mark.parametrize("log", [True])
def test_tools(spark, tmp_path, log):
    code = tmp_path / "code"
    code.mkdir()
    (code / "reader.py").write_text("def read_stream(path):\n    return open(path)\n\n\nclass Cache:\n    def get(self, key):\n        return key\n")
    (code / "notes.md").write_text("The cache keeps every stream until it is read.\n")
    m = Memory(spark, f"file://{tmp_path}/db", [str(tmp_path)], generator=lambda p: "they belong together")
    p = m.index_project(str(code), "My Code")
    assert p.startswith("my_code_") and m.project_info(p)["file_count"] == 2 and m.project_health(p)["healthy"]
    found = m.search_memory("cache stream", p, 5, fts_mode="any")
    assert found["count"] == 2 and len(m.table("search_sessions").collect()) == 1
    assert m.get_chunk(p, found["results"][0]["id"])["project_id"] == p and m.get_chunk(p, "none") is None
    assert {n["name"] for n in m.query_graph_nodes(p)} == {"read_stream", "Cache", "get"}
    assert m.find_symbol_references("Cache", p)["definitions"][0]["name"] == "Cache"
    assert m.graph_search(p, "read_stream cache")[0]["graph_match"]
    stack = m.analyze_error_stack(f'File "{code}/reader.py", line 2', p)
    assert stack["total_frames"] == 1 and "read_stream" in stack["code_context"][0]["content"]
    assert m.update_memory_bank(p, "active/Context", "now")["section"] == "activeContext"
    m.update_memory_bank(p, "activeContext", "later")
    assert m.get_project_context(p)["memory"] == {"activeContext": "later"}
    (code / "notes.md").write_text("Nothing is left here.\n")
    (code / "new.txt").write_text("a new file")
    assert m.update_project(p) == {"added": 2, "deleted": 1}
    assert m.get_project_context(p)["memory"] == {"activeContext": "later"}
    from palimpsest.operators.history import MARKER

    sec = lambda h, t, s, f: f"{MARKER}{h}|Ann|{t}|{s}\n" + "".join(f"M\t{x}\n" for x in f) + "\n" + "".join(f"diff --git a/{x} b/{x}\n--- a/{x}\n+++ b/{x}\n+{s}\n" for x in f)
    (tmp_path / "log.txt").write_text(sec("a" * 40, 1, "fix cache eviction", ["reader.py", "notes.md"]) + sec("b" * 40, 2, 'Revert "fix cache eviction"', ["reader.py", "notes.md"]) + sec("c" * 40, 3, "wip", ["x"]))
    assert m.index_git_history(p, str(tmp_path / "log.txt")) == {"commits": 2, "diffs": 4, "tags": 2}
    assert m.search_history("cache", p)["total_commits"] == 2 and m.search_history("cache", p, "nowhere")["total_commits"] == 0
    assert m.analyze_temporal_couplings(p, 2)["edges_injected"] == 2 and m.find_references(p, f"{p}:notes.md:FILE:notes.md")
    assert m.analyze_reverts(p)["rules_generated"] == 1
    assert m.analyze_file_coding_style(p, "reader.py")["style_guide"] == "they belong together"
    first = m.search_memory("read", p, 5, fts_mode="any")
    n = m.table("search_sessions").count()
    assert m.search_memory("read", p, 5, fts_mode="any") is first and m.table("search_sessions").count() == n
    m.search_memory("read", p, 4, fts_mode="any")
    assert m.dream_project(p, 1)["insights"] == 1 and m.trigger_rem_cycle(p)["insights"] >= 0
    insight = m.table("chunks", p).where("file_path = 'vfs://insights/dream_cycle.md'").first()
    assert insight.content == "they belong together" and json.loads(insight.metadata)["source_chunks"] == sorted(json.loads(insight.metadata)["source_chunks"])
    assert m.repair_project(p)["healthy"] and m.get_codebase_overview(p)["files"] >= 3
    given = m.get_chunk(p, first["results"][0]["id"])["access_count"]
    assert given >= 2 and {r.chunk_id: r.access_count for r in m.accesses(p).collect()}[first["results"][0]["id"]] == given
    assert m.prune_sessions(p, max_rows=1) == 2 and m.get_chunk(p, first["results"][0]["id"])["access_count"] == given
    assert m.prune_sessions(p, max_age_s=3600) == 0
    held = m.table("embedding_cache").count()
    assert m.prune_cache(max_rows=2) == held - 2 and m.table("embedding_cache").count() == 2
    assert {j["status"] for j in m.list_jobs()} == {"COMPLETED"} and not m.cancel_job("none")
    m._say("left", "index_project", p, "PROCESSING")
    assert m.fail_stale_jobs() == 1 and m._job_row("left")["status"] == "FAILED"
    m._say("open", "index_project", p, "PROCESSING")
    assert m.cancel_job("open") and not m.cancel_job("open") and m._job_row("open")["status"] == "CANCELLED"
    assert m.prune_jobs(max_rows=2) >= 1 and len(m.list_jobs()) == 2
    with pytest.raises(ValueError):
        m.index_project(str(code), "a\x00b")
    with pytest.raises(PermissionError):
        m.index_project("/etc", "x")
    with pytest.raises(ValueError):
        m.search_memory("x " * 300, p)
    m.delete_project(p)
    assert m.list_projects() == [] and all(m.table(n, p).count() == 0 for n in tools.OWNED)


def test_index_of_a_tree_with_everything(spark, tmp_path):
    import zipfile

    code = tmp_path / "code (1)"
    (code / ".github").mkdir(parents=True)
    (code / "pkg").mkdir()
    (code / "pkg/__init__.py").write_text("\n\n\ndef start():\n    return 1\n" + "\n".join(f"x{i} = {i}" for i in range(300)))
    (code / ".github/ci.yml").write_text("on: push")
    (code / "latin.txt").write_bytes("the caf\u00e9 opens".encode("latin-1"))
    xml = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Minutes of the harbour board</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(code / "minutes.docx", "w") as z:
        z.writestr("word/document.xml", xml)
    calls = []
    m = Memory(spark, f"file://{tmp_path}/db", [str(tmp_path)])
    p = m.index_project(str(code), "All")
    assert {r.file_path for r in m.table("file_metadata", p).collect()} == {"pkg/__init__.py", ".github/ci.yml", "latin.txt", "minutes.docx"}
    assert m.search_memory("harbour board", p)["results"][0]["content"] == "Minutes of the harbour board"
    rows = m.table("chunks", p).where("file_path = 'pkg/__init__.py'").orderBy("internal_id").collect()
    text = (code / "pkg/__init__.py").read_text().split("\n")
    for r in rows:
        lines = r.content.split("\n")
        assert text[r.start_line - 1].endswith(lines[0]) and text[r.end_line - 1].startswith(lines[-1]) and r.end_line - r.start_line == len(lines) - 1
    # An update reads only what changed; chunks that are the same keep their numbers and vectors.
    before = {r.chunk_id: r.internal_id for r in m.table("chunks", p).collect()}
    read = files.texts
    try:
        files.texts = lambda f, *a: (calls.append(sorted(r.rel_path for r in f.collect())), read(f, *a))[1]
        (code / "latin.txt").write_text("the kiosk opens")
        (code / "pkg/new.py").write_text("def fresh():\n    pass\n")
        (code / ".github/ci.yml").unlink()
        assert m.update_project(p) == {"added": 2, "deleted": 2}
    finally:
        files.texts = read
    assert calls == [["latin.txt", "pkg/new.py"]]
    after = {r.chunk_id: r.internal_id for r in m.table("chunks", p).collect()}
    assert all(after[k] == before[k] for k in set(after) & set(before)) and len(set(after) & set(before)) == len(rows) + 1
    assert m.project_health(p)["healthy"] and m.search_memory("kiosk", p)["count"] >= 1
    assert {n["name"] for n in m.query_graph_nodes(p)} == {"start", "fresh"}


def test_project_of_files_that_cannot_be_read_is_refused(spark, tmp_path, monkeypatch):
    (tmp_path / "code").mkdir()
    for i in range(8):
        (tmp_path / f"code/{i}.txt").write_text("x")
    m = Memory(spark, f"file://{tmp_path}/db", [str(tmp_path)])
    read = files.texts
    monkeypatch.setattr(files, "texts", lambda f, *a: read(f, *a).where("rel_path > '5'"))
    with pytest.raises(RuntimeError):
        m.index_project(str(tmp_path / "code"), "Lost")
    assert [j["status"] for j in m.list_jobs()] == ["FAILED"]


def test_searches_start_a_cycle_where_that_is_on(spark, tmp_path):
    (tmp_path / "code").mkdir()
    (tmp_path / "code/a.md").write_text("tide and harbour")
    (tmp_path / "code/b.md").write_text("tide and mole")
    m = Memory(spark, f"file://{tmp_path}/db", [str(tmp_path)], generator=lambda p: "both are of the sea", auto_dream=True, auto_every=2)
    p = m.index_project(str(tmp_path / "code"), "Sea")
    m.search_memory("tide", p)
    assert m.table("chunks", p).count() == 2
    m.search_memory("tide", p, 9)
    assert m.table("chunks", p).where("file_path like 'vfs://insights/%'").count() == 1


def test_shared_folder_is_asked_for_on_a_cluster(monkeypatch):
    from palimpsest import session

    class Ctx:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda s: type("S", (), {"getCheckpointDir": lambda s: type("O", (), {"isDefined": lambda s: False})()})()})()

    fake = type("Spark", (), {"conf": type("C", (), {"get": lambda s, k, d=None: None})(), "sparkContext": Ctx()})()
    with pytest.raises(RuntimeError):
        session.shared_dir(fake)


def test_cut_tables_go_when_nothing_needs_them(tmp_path):
    """In a session of its own, which nothing else holds plans in."""
    import subprocess
    import sys

    code = f"""
import gc, time
from palimpsest import session
spark = session.get_spark(2, 2, "1g")
spark.sparkContext.setCheckpointDir("file://{tmp_path}/shared")

def held(path):
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    session._sweep(spark)
    return path in {{p for _, p in session._CUTS}}

one = session.cut(spark.range(5))
path = session._CUTS[-1][1]
both = one.join(session.cut(spark.range(3)), "id")
del one
assert held(path) and both.count() == 3
del both
until = time.monotonic() + 60
while (left := held(path)) and time.monotonic() < until:
    time.sleep(0.5)
assert not left
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=180, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_hubs_and_large_memory_banks_come_whole(spark, tmp_path):
    m = Memory(spark, f"file://{tmp_path}/db", [str(tmp_path)])
    n = 1100
    m._add("graph_edges", "p", spark.range(n).select(F.lit("p").alias("project_id"), F.format_string("n%04d", "id").alias("source_id"), F.lit("hub").alias("target_id"), F.lit("calls").alias("edge_type")))
    found = m.find_references("p", "hub")
    assert [r["peer_id"] for r in found] == [f"n{i:04d}" for i in range(n)]
    bank = spark.range(n).select(F.lit("p").alias("project_id"), F.col("id").cast("string").alias("chunk_id"), F.col("id").alias("internal_id"), F.format_string("vfs://memory/s%04d.md", F.floor(F.col("id") / 2)).alias("file_path"), F.concat(F.lit("now"), "id").alias("content"))
    m._add("chunks", "p", m._empty("chunks").unionByName(bank, allowMissingColumns=True))
    memory = m.get_project_context("p")["memory"]
    assert len(memory) == n // 2 and memory["s0003"] == "now6\n\nnow7"


def test_without_the_llm_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['palimpsest.llm'] = None; import __spark_entry__ as e; assert 'hybrid_search' in e.queries() and 'p1_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_documents(spark, tmp_path):
    import zipfile

    from palimpsest.sources import documents

    xml = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>' + "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in ("One", " ", "two words")) + "</w:body></w:document>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "b.docx").write_bytes(b"broken")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-broken")
    (tmp_path / "d.txt").write_text("x")
    found = documents.units(files.scan(spark, str(tmp_path)))
    assert [(r.rel_path, r.text) for r in found.collect()] == [("a.docx", "One\ntwo words")]
    assert [r.content for r in documents.ingest_units(found).collect()] == ["One\ntwo words"]


def test_http_embedder(spark):
    import http.server
    import json
    import threading

    calls = []

    class Answer(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            calls.append(self.path)
            if len(calls) == 1:
                self.send_error(503)
                return
            out = json.dumps({"data": [{"index": i, "embedding": [float(len(t))]} for i, t in enumerate(body["input"])]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *a):
            pass

    s = http.server.HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    from palimpsest.sources.embedders import http_embedder

    df = spark.createDataFrame([("ab",), (None,), ("abc",)], "t string").coalesce(1)
    got = [r.v for r in df.select(http_embedder(f"http://127.0.0.1:{s.server_port}", "m", batch=2)("t").alias("v")).collect()]
    s.shutdown()
    assert got == [[2.0], [0.0], [3.0]] and calls == ["/embeddings"] * 3
