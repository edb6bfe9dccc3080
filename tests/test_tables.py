import random
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.operators import catalog, graph, history, incremental, mining, pairs
from palimpsest.sources.store import Conflict, VersionedTable


def test_merges(spark):
    old = spark.createDataFrame([("a", 1, 5), ("b", 2, 6)], "k string, n int, m int")
    new = spark.createDataFrame([("b", 20, 60), ("c", 30, 70)], "k string, n int, m int")
    got = {tuple(r) for r in catalog.upsert(old, new, ["k"], ["n"]).collect()}
    assert got == {("a", 1, 5), ("b", 2, 60), ("c", 30, 70)}
    assert {r.k for r in catalog.insert_ignore(old, new.union(new), ["k"]).collect()} == {"a", "b", "c"}
    assert catalog.insert_ignore(old, new.union(new), ["k"]).count() == 3
    assert [r.k for r in catalog.delete(old, new, ["k"]).collect()] == ["a"]
    fixed = catalog.repair_ids(spark.createDataFrame([("p", "x", 1), ("p", "y", 9)], "g string, k string, n int"), spark.createDataFrame([("p", "z", 1), ("p", "w", 4)], "g string, k string, n int"), "g", "k", "n")
    assert {(r.k, r.n) for r in fixed.collect()} == {("x", 5), ("y", 9)}


def test_snapshots(spark):
    cols = "file_path string, mtime_ns long, size_bytes long, content_hash string"
    old = spark.createDataFrame([("same", 1, 1, "h"), ("touched", 1, 1, "h"), ("new hash", 1, 1, "h"), ("gone", 1, 1, "h"), ("nulls", 1, None, None)], cols)
    new = spark.createDataFrame([("same", 1, 1, None), ("touched", 2, 1, "h"), ("new hash", 2, 1, "i"), ("fresh", 1, 1, "h"), ("nulls", 1, None, None)], cols)
    got = {r.file_path: r.change for r in catalog.snapshot_changes(old, new, ["file_path"]).collect()}
    assert got == {"same": "unchanged", "touched": "unchanged", "new hash": "modified", "gone": "deleted", "fresh": "added", "nulls": "modified"}


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    assert t.load() is None
    assert t.publish(spark.range(3)) == 1 and t.publish(spark.range(5)) == 2
    assert t.load().count() == 5 and t.load(1).count() == 3
    with pytest.raises(Conflict):
        t.publish(spark.range(9), expected=1)
    assert t.load().count() == 5


def test_interleaved_writers_lose_nothing(spark, tmp_path):
    a, b = (VersionedTable(spark, f"file://{tmp_path}/t") for _ in range(2))
    a.append("p", spark.range(2))
    at = a.version()
    b.append("q", spark.range(10, 13))
    b.append("p", spark.range(20, 21))
    with pytest.raises(Conflict):  # p is not what it was at `at`
        a.replace("p", spark.range(1), at)
    a.replace("q", spark.range(30, 32), a.version())
    assert sorted(r.id for r in a.load().collect()) == [0, 1, 20, 30, 31]
    calls = []

    def make(old):
        calls.append(1)
        if len(calls) == 1:
            b.append("p", spark.range(50, 51))
        return old.where("id > 0")

    a.change("p", make)
    assert len(calls) == 2 and sorted(r.id for r in b.load(part="p").collect()) == [1, 20, 50]
    for i in range(30):
        a.append("log", spark.range(i, i + 1).coalesce(1))
    assert a.load(part="log").count() == 30 and sum(p == "log" for p, _ in a.entries(a.version())) < 30
    assert len(a.versions()) <= 9
    a.change("p", lambda old: None)
    assert a.load(part="p") is None


def test_incremental_run_survives_failure(spark, tmp_path):
    s = incremental.IncrementalState(spark, f"file://{tmp_path}/s", ["k"])
    df = lambda *rows: spark.createDataFrame(rows, "k string, content_hash string, change2 int")
    seen = []
    keep = lambda x, v: seen.append((v, {(r.k, r.change) for r in x.collect()}))
    assert s.run(df(("a", "1", 0), ("b", "1", 0), ("b", "1", 0), ("n", None, 0)), keep) == 1
    assert seen[-1] == (1, {("a", "new"), ("b", "new")})

    def fail(x, v):
        raise OSError("lost")

    with pytest.raises(OSError):
        s.run(df(("a", "2", 0), ("c", "1", 0)), fail)
    # What the failed run was to do comes again under its number, what is new since then after it.
    assert s.run(df(("a", "2", 0), ("c", "1", 0), (None, "7", 0)), keep) == 3
    assert seen[-2:] == [(2, {("a", "changed"), ("c", "new")}), (3, {(None, "new")})]
    assert s.run(df(("a", "2", 0), ("b", "1", 0), ("c", "1", 0), (None, "7", 0)), keep) == 4 and seen[-1] == (4, set())
    assert s.run(df(("a", "2", 0), ("b", None, 0)), keep, True) == 5 and seen[-1] == (5, {("c", "removed"), (None, "removed")})
    assert {(r.k, r.content_hash) for r in s.rows().collect()} == {("a", "2"), ("b", "1")}


def test_incremental_run_killed_between_work_and_swap(spark, tmp_path, monkeypatch):
    s = incremental.IncrementalState(spark, f"file://{tmp_path}/s", ["k"])
    sink = {}  # a sink that knows versions: a repeated one replaces itself
    work = lambda x, v: sink.__setitem__(v, sorted((r.k, r.content_hash) for r in x.collect()))
    df = lambda *rows: spark.createDataFrame(rows, "k string, content_hash string")
    s.run(df(("a", "1")), work)
    point = s.table._point
    monkeypatch.setattr(s.table, "_point", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        s.run(df(("a", "2"), ("b", "1")), work)
    monkeypatch.setattr(s.table, "_point", point)
    assert s.table.version() == 1
    s.run(df(("a", "3"), ("b", "1")), work)
    assert sink == {1: [("a", "1")], 2: [("a", "2"), ("b", "1")], 3: [("a", "3")]}


def test_incremental_state_is_written_anew_after_many_versions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "COMPACT", 3)
    s = incremental.IncrementalState(spark, f"file://{tmp_path}/s", ["k"])
    for i in range(7):
        s.run(spark.createDataFrame([("a", str(i)), (f"k{i}", "1")], "k string, content_hash string"), lambda x, v: None)
    assert len(s.table.entries(7)) <= 3
    assert {(r.k, r.content_hash) for r in s.rows().collect()} == {("a", "6")} | {(f"k{i}", "1") for i in range(7)}


def test_incremental_state_of_a_source_that_changes_while_it_is_worked_on(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.txt").write_text("one")
    s = incremental.IncrementalState(spark, f"file://{tmp_path}/s", ["path"])
    current = lambda: spark.read.format("binaryFile").load(f"file://{tmp_path}/src").select("path", F.sha2("content", 256).alias("content_hash"), F.col("content").cast("string").alias("text"))
    seen = []

    def work(x, version):
        seen.append([r.text for r in x.collect()])
        (tmp_path / "src/a.txt").write_text("two")

    assert s.run(current(), work) == 1 and s.run(current(), work) == 2 and s.run(current(), work) == 3
    assert seen == [["one"], ["two"], []]


def test_numbers_and_running_sums(spark):
    r = random.Random(3)
    rows = [(r.choice(["p", "q", None]), i, r.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k int, v long").repartition(7)
    want, sums, n = {}, {}, {}
    for g, k, v in sorted(rows, key=lambda x: (x[0] or "", x[1])):
        n[g] = n.get(g, 0) + 1
        sums[g] = sums.get(g, 0) + v
        want[k] = (n[g] + 10, sums[g])
    got = {x.k: x.n for x in catalog.numbered(df, ["k"], "n", 10, ["g"]).collect()}
    assert got == {k: w[0] for k, w in want.items()}
    assert {x.k: x.s for x in catalog.running(df, ["g"], ["k"], "v", "s").collect()} == {k: w[1] for k, w in want.items()}
    assert catalog.numbered(df.limit(0), ["k"], "n").count() == 0


def test_pairs_of_a_hot_record_in_blocks(spark):
    rows = [("hot", f"i{i:03d}", i % 3) for i in range(90)] + [("cold", "a", 0), ("cold", "b", 1), ("one", "a", 0), (None, "a", 0), (None, "b", 0)]
    df = spark.createDataFrame(rows, "rec string, item string, f int")
    got = sorted((r.rec, r.item_a, r.item_b, r.f_a, r.f_b) for r in pairs.pairs_within(df, ["rec"], "item", ["f"], block=16).collect())
    want = sorted((a[0], a[1], b[1], a[2], b[2]) for a in rows for b in rows if a[0] == b[0] and a[0] and a[1] < b[1])
    assert got == want


def test_p3_found_is_driven_through_the_state(spark, monkeypatch):
    from palimpsest.plans import incremental as plan
    from palimpsest.session import table

    d, versions = "/root/testdata/sf0.01", []
    run = incremental.IncrementalState.run
    monkeypatch.setattr(incremental.IncrementalState, "run", lambda self, *a: versions.append(run(self, *a)) or versions[-1])
    got = sorted(tuple(r) for r in plan.p3_found(spark, d).collect())
    runs, real = table(spark, d, "scan_runs").where("kind = 'update_project' AND status = 'COMPLETED'"), ~F.col("file_path").startswith("vfs://")
    want = incremental.replay(runs, table(spark, d, "file_scans").where(real), table(spark, d, "file_metadata").where(real), "project_id", "job_id", "created_at", ["file_path"], "arrived_at", "observed_at", "scan_id", "content_hash")
    assert got == sorted(tuple(r) for r in want.collect()) and got
    assert len(versions) > 1 and versions == list(range(2, len(versions) + 2))


def brute_replay(runs, scans, base):
    out = set()
    for p in {r[1] for r in runs}:
        mine = sorted({(r[2], r[0]) for r in runs if r[1] == p})
        files = {s[2] for s in scans if s[1] == p} | {b[1] for b in base if b[0] == p}
        before = {f: max((b[2] for b in base if b[:2] == (p, f) and b[2] is not None), default=None) for f in files}
        start = dict(before)
        for at, job in mine:
            for f in files:
                seen = [s for s in scans if s[1] == p and s[2] == f and s[4] <= at and s[5] is not None]
                now = max(seen, key=lambda s: (s[3], s[0]))[5] if seen else start[f]
                if now is not None and now != before[f]:
                    out.add((job, p, f))
                before[f] = now
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000))
def test_replay(spark, seed):
    r = random.Random(seed)
    t = lambda: datetime(2025, 1, 1) + timedelta(hours=r.randint(0, 200))
    runs = [(f"j{i}", r.choice("pq"), t()) for i in range(9)]
    scans = [(i, r.choice("pqz"), r.choice("abc"), t(), t(), r.choice(["h1", "h2", None])) for i in range(40)]
    base = [(p, f, r.choice(["h1", "h2", None])) for p in "pq" for f in "abd" if r.random() < 0.7]
    got = incremental.replay(
        spark.createDataFrame(runs + runs[:2], "job string, p string, at timestamp"), spark.createDataFrame(scans, "id long, p string, f string, seen timestamp, came timestamp, h string"),
        spark.createDataFrame(base, "p string, f string, h string"), "p", "job", "at", ["f"], "came", "seen", "id", "h",
    )
    assert {tuple(x) for x in got.collect()} == brute_replay(runs, scans, base)


def test_diff_paths_and_sections(spark):
    block = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@\n+1"
    gone = "diff --git a/y b/y\n--- a/y\n+++ /dev/null\n-1"
    binary = "diff --git a/z b/z\nBinary files a/z and b/z differ"
    quoted = 'diff --git "a/q r" "b/q r"\n--- "a/q r"\n+++ "b/q r"\n+' + "l" * 3000
    odd = 'diff --git "a/t\\tq\\"" "b/t\\tq\\""\n--- "a/t\\tq\\""\n+++ "b/t\\tq\\""\n+1'
    section = history.MARKER + "abc|Ann|12|fix a|b\nM\tx\nD\ty\nA\tz\nR100\told\tq r\n\n" + "\n".join([block, gone, binary, quoted, odd])
    df = spark.createDataFrame([(section,), ("bad",), (None,), ("a|b|c|d\nx",), ("h|a|5|only\n",)], "s string")
    parsed = history.parse_sections(df, "s")
    assert {(r.commit_hash, r.author, r.timestamp, r.message) for r in parsed.collect()} == {("abc", "Ann", 12, "fix a|b"), ("h", "a", 5, "only")}
    rows = {r.file_path: (r.change_type, len(r.diff_content)) for r in history.parse_diffs(parsed).collect()}
    assert rows == {"x": ("MODIFIED", len(block)), "y": ("DELETED", len(gone)), "z": ("ADDED", len(binary)), "q r": ("MODIFIED", 2000 + len(history.DIFF_CUT)), 't\tq"': ("MODIFIED", len(odd))}


def test_reverts(spark):
    h = "a" * 40
    rows = [(h, "p", 1, "fix crash in parser"), ("b" * 40, "p", 2, 'Revert "fix crash in parser"'), ("c" * 40, "p", 3, f"Revert {h[:9]}"), ("d" * 40, "q", 9, 'Revert "fix crash in parser"'), ("e" * 40, "p", 4, None)]
    c = spark.createDataFrame([(a, b, t, m) for a, b, t, m in rows], "commit_hash string, project_id string, timestamp long, message string")
    pairs = {r.revert_hash[0]: r.original_hash[0] for r in history.revert_pairs(c).collect()}
    assert pairs == {"b": "a", "c": "a"}
    x = spark.createDataFrame([("1", h, "f.py"), ("2", h, "g.py")], "id string, commit_hash string, file_path string")
    rules = history.revert_rules(history.revert_pairs(c), c, x).collect()
    assert [(r.rule_id, r.file_pattern, r.priority) for r in rules] == [("immune_system_" + "a" * 12, "f.py|g.py", 10)]


def test_frames_and_context(spark):
    trace = 'File "/repo/a.py", line 42, in f\nat fn (/repo/app.js:10:5)\nat x (/r/node_modules/y.js:1:1)\nat src/main.rs:42:5'
    df = spark.createDataFrame([(1, trace), (2, None), (3, "")], "id int, t string")
    got = [(r.file, r.line, r.language) for r in graph.frames(df, "id", "t").orderBy("pos").collect()]
    assert got == [("/repo/a.py", 42, "python"), ("/repo/app.js", 10, "javascript"), ("src/main.rs", 42, "javascript"), ("src/main.rs", 42, "rust_or_go")]
    spans = spark.createDataFrame([("/repo/a.py", 1, 20, "c1", 1), ("/repo/a.py", 40, 60, "c3", 3), ("/repo/a.py", 21, 39, "c2", 2), ("/repo/app.js", None, None, "d", 1)], "file string, start_line int, end_line int, chunk_id string, internal_id long")
    rows = {(r.file, r.language): r.chunk_id for r in graph.frame_context(graph.frames(df, "id", "t"), spans, ["pos"]).collect()}
    assert rows == {("/repo/a.py", "python"): "c2", ("/repo/app.js", "javascript"): "d", ("src/main.rs", "javascript"): None, ("src/main.rs", "rust_or_go"): None}


SNIPPETS = {"rs": "pub fn foo() {\n}\nstruct Bar {\n}", "go": "func Foo(a int) error {\n}", "java": "public class A {\n  public int f(int x) {\n  }\n}", "cs": "class A {\n void F() {\n }\n}", "c": "int main(void) {\n return 0;\n}", "h": "struct s {\n int a;\n};", "cpp": "class A {\n};", "hpp": "struct B {\n};", "js": "function f() {\n}", "ts": "export interface I {\n}", "tsx": "export function C() {\n}"}


@pytest.mark.parametrize("ext", SNIPPETS)
def test_symbols_of_brace_languages(ext):
    assert graph.polyglot_symbols(SNIPPETS[ext]) and graph.polyglot_symbols(SNIPPETS[ext], f".{ext}")


def test_braces_in_comments_and_literals_do_not_count():
    java = "class A { // {{{\n  String s = \"}\"; /* void no() { */\n  public int f(int x) {\n    if (x > 0) { return g(x); }\n    return '}';\n  }\n}\ninterface B {\n  int h();\n}\n"
    assert graph.polyglot_symbols(java, ".java") == [("class", "A", 1, 7), ("function", "f", 3, 6), ("class", "B", 8, 10), ("function", "h", 9, 9)]
    rust = "impl<'a> Show for Item<'a> {\n    fn show(&self) -> char { '}' }\n}\npub struct Unit;\nfn last() {\n}\n"
    assert graph.polyglot_symbols(rust, ".rs") == [("class", "Item", 1, 3), ("function", "show", 2, 2), ("class", "Unit", 4, 4), ("function", "last", 5, 6)]
    go = "package a\n\ntype T struct {\n}\n\nfunc (t *T) Run(n int) error {\n\treturn f(func() {\n\t})\n}\n"
    assert graph.polyglot_symbols(go, ".go") == [("class", "T", 3, 4), ("function", "Run", 6, 9)]
    ts = "export interface P { a: string }\nexport function v<T>(p: T) {\n  return `{${p}`;\n}\n"
    assert graph.polyglot_symbols(ts, ".ts") == [("class", "P", 1, 1), ("function", "v", 2, 4)]
    c = "static int add(struct s *p, int b)\n{\n\treturn p->a + b;\n}\nint declared(int);\nstruct s {\n int a;\n};\n"
    assert graph.polyglot_symbols(c, ".c") == [("function", "add", 1, 4), ("class", "s", 6, 8)]
    graph.register_language((".zz",), r"proc (?P<f>\w+)")
    assert graph.polyglot_symbols("proc one {\n}", ".zz") == [("function", "one", 1, 2)]
    del graph.LANGUAGES[".zz"]


def test_python_symbols(spark):
    src = "\n\ndef f():\n    pass\n\nasync def g():\n    pass\n\nclass C:\n    def m(self):\n        pass\n"
    assert graph.python_symbols(src) == [("function", "f", 3, 4), ("function", "g", 6, 7), ("class", "C", 9, 11), ("function", "m", 10, 11)]
    assert graph.python_symbols("def (") == graph.python_symbols(None) == graph.python_symbols("") == []
    df = spark.createDataFrame([("a.py", src), ("b.go", SNIPPETS["go"]), ("c.py", None)], "path string, text string")
    assert {(r.path, r.name) for r in graph.extract_symbols(df, "path", "text").collect()} == {("a.py", "f"), ("a.py", "g"), ("a.py", "C"), ("a.py", "m"), ("b.go", "Foo")}


def test_rules(spark):
    df = spark.createDataFrame([("x/a.py", "t"), ("src/q/r.ts", "t"), (None, "t"), ("b.md", "t")], "path string, text string")
    got = [r.text for r in graph.inject_rules(df, [("*.py", "one", 1), ("src/**/*.ts|a.py", "two", 5)], "path", "text").collect()]
    assert got == ["[Repo Constraint]: one\n\nt", "[Repo Constraint]: two\n\nt", "t", "t"]


def test_trigger():
    t = mining.TriggerState()
    assert [t.see(1000.0 + i) for i in range(24)] == [False] * 24 and t.see(1030.0)
    assert not any(t.see(2000.0 + i) for i in range(40))  # one a day
    assert t.see(2000.0 + 86_400)


def test_co_retrieved(spark):
    s = spark.createDataFrame([("p", "s1", 1, ["a", "b", "a", None]), ("p", "s2", 2, ["b", "a", "c"]), ("p", "s3", 3, ["a"]), ("p", "s4", 4, None)], "project_id string, session_id string, created_at int, result_chunk_ids array<string>")
    f = spark.createDataFrame([("p", "a", "f1"), ("p", "b", "f2"), ("p", "c", "f1")], "project_id string, chunk_id string, file_path string")
    got = {(r.chunk_a, r.chunk_b): r.pair_count for r in mining.co_retrieved(s, f).collect()}
    assert got == {("a", "b"): 2, ("b", "c"): 1}
    known = spark.createDataFrame([("a", "b")], "chunk_a string, chunk_b string")
    assert {(r.chunk_a, r.chunk_b) for r in mining.co_retrieved(s, f, known).collect()} == {("b", "c")}
    assert mining.co_retrieved(s, f, last=1).count() == 0


def test_couplings(spark):
    c = spark.createDataFrame([(f"c{i}", "p", i, "m") for i in range(4)], "commit_hash string, project_id string, timestamp long, message string")
    x = spark.createDataFrame([(f"c{i}", f) for i in range(4) for f in (["a", "b"] if i else ["a", "b", "z"])] + [("c1", "a"), ("c2", None)], "commit_hash string, file_path string")
    pairs = history.couplings(x, c, 3)
    assert [(r.file_a, r.file_b, r.frequency) for r in pairs.collect()] == [("a", "b", 4)]
    assert history.couplings(x, c, 3, recent=2).count() == 0
    assert [r.commit_hash for r in history.coupling_commits(pairs, x, c).orderBy("rn").collect()] == ["c3", "c2", "c1"]
    assert history.couplings(x.where(F.lit(False)), c, 3).count() == 0
