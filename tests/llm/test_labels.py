import random

from palimpsest.llm import langid, provenance

SAID = {
    "en": "the nightly job reads every file before the lock is released and nobody could explain why it was slow".split(),
    "de": "der nächtliche auftrag liest jede datei bevor die sperre aufgehoben wird und niemand konnte es erklären".split(),
    "fr": "la tâche de nuit relit chaque fichier avant que le verrou soit libéré et personne ne comprenait pourquoi".split(),
}


def text(lang, n=4):
    return ". ".join(" ".join(random.sample(SAID[lang], 9)).capitalize() for _ in range(n)) + "."


def docs():
    random.seed(7)
    rows = []
    for i in range(120):
        lang = ["en", "de", "fr"][i % 3]
        rows.append((i, text(lang) + "\n\n" + text(lang), random.choice([lang, lang.upper()])))
    wrong = [(1000, text("de") + "\n\n" + text("de"), "en"), (1001, text("fr"), None), (1002, text("en"), "zz"), (1003, "# name_x\n\n" + text("en", 8) + "\n\n```\nlet x = 1\n\nfoo\n```\n\n" + text("de", 2), "English")]
    silent = [(2000, None, "en"), (2001, "", "de"), (2002, " \n ", "fr"), (2003, "```\ncode here\n```", "fr"), (2004, "cache_mark: 1994", "fr")]
    return rows, wrong, silent


def test_languages(spark):
    rows, wrong, silent = docs()
    df = spark.createDataFrame([(*r, "x") for r in rows + wrong + silent], "id long, text string, lang string, para_no string")
    aliases = spark.createDataFrame([("en", "en"), ("en", "english"), ("de", "de"), ("fr", "fr")], "lang string, alias string")
    found = langid.detect(df, "id", "text", "lang", aliases)
    got = {(r.id, r.para_no, r.lang) for r in langid.mislabelled(found, "id").collect()}
    assert got == {(1000, 0, "de"), (1001, 0, "fr"), (1002, 0, "en"), (1003, 5, "de")}
    ids = {r.id for r in found.collect()}
    assert not ids & {2000, 2001, 2002, 2003, 2004} and len(ids) == 124
    assert langid.detect(df.limit(0), "id", "text", "lang", aliases).count() == 0


def test_paragraph_numbers():
    t = "a b\r\n\r\n \t\n```\nx\n\ny\n```\nc d\n\n\ne"
    assert [n for n, _ in langid.paragraphs(t.replace("\r\n", "\n"))] == [1, 2, 3, 4]


def test_repair():
    assert langid.repair("fÃ¤llt ins StÃ¼ck") == "fällt ins Stück"
    assert langid.repair("São Âmbar") == "São Âmbar"


def test_files(spark):
    code = "import os\n\ndef f(a):\n    return a + 1\n" * 5
    mini = "!function(e,t){" + "var a=b.c(d,1);" * 60 + "}"
    blob = "static const unsigned char x[] = {\n" + "0x4d, 0xc8, 0x44, " * 90 + "};"
    lib = "// Vendored from foo 1.2.3; do not reformat.\n" + code
    files = {
        "src/a/one.py": code, "src/a/two.py": code, "src/b/gen.go": "// Code generated by x. DO NOT EDIT.\n" + code, "src/b/hand.go": code + '\nX = "// Code generated by %s. DO NOT EDIT."',
        "web/app.min.js": None, "web/x.js": mini, "src/data.c": blob, "lib/foo/a.c": lib, "lib/foo/b.c": lib, "lib/foo/c.c": None, "node_modules/x/y/z.js": code, ".\\vendor\\q\\z.go": code,
        "pkg/package-lock.json": None, "src/vendors/list.js": code, "src/min.md": "minified size\n" * 5, "vfs://memory/a.md": "@generated\n", "README.md": "# Generated docs are good", "src/notes.py": "# rewritten by hand; the old auto-generated version was removed\n" + code,
    }
    fm = spark.createDataFrame([("p", f, "x") for f in files] + [("p", "src/a/one.py", "x"), (None, "a", "x"), ("p", None, "x")], "project_id string, file_path string, label string")
    fc = spark.createDataFrame([("p", f, f"c{i}") for i, f in enumerate(files)] + [("p", "gone.py", "c0"), ("p", None, "c1")], "project_id string, file_path string, chunk_id string")
    ch = spark.createDataFrame([(f"c{i}", t, 1) for i, t in enumerate(files.values())] + [("c0", code, 1)], "chunk_id string, content string, generated int")
    out = {r.file_path: r.label for r in provenance.label_files(fm, fc, ch).collect()}
    assert set(out) == set(files)
    want = {"src/b/gen.go": "generated", "web/app.min.js": "minified", "web/x.js": "minified", "src/data.c": "blob", "lib/foo/a.c": "vendored", "lib/foo/b.c": "vendored", "lib/foo/c.c": "vendored", "node_modules/x/y/z.js": "vendored", ".\\vendor\\q\\z.go": "vendored", "pkg/package-lock.json": "generated"}
    assert {f: x for f, x in out.items() if x != "handwritten"} == want
    assert provenance.label_files(fm.limit(0), fc, ch).count() == 0


def test_propagation_equals_enumeration(spark):
    """Exact marginals on a small tree, against summing over all labelings."""
    import itertools
    import math

    fm = spark.createDataFrame([("p", "d/a.min.js"), ("p", "d/b.js"), ("p", "c.js")], "project_id string, file_path string")
    none = spark.createDataFrame([], "project_id string, file_path string, chunk_id string")
    ch = spark.createDataFrame([], "chunk_id string, content string")
    got = {r.file_path: r.confidence for r in provenance.label_files(fm, none, ch).collect()}
    seen = (0.004, 0.05, 1, 0.05, 0.02)
    total, sums = 0.0, {f: [0.0] * 5 for f in got}
    for root, d, a, b, c in itertools.product(range(5), repeat=5):
        p = provenance.ROOT[root] * provenance.DIR_IN[root][d] * provenance.FILE_IN[d][a] * provenance.FILE_IN[d][b] * provenance.FILE_IN[root][c] * seen[a]
        total += p
        for f, x in (("d/a.min.js", a), ("d/b.js", b), ("c.js", c)):
            sums[f][x] += p
    assert all(math.isclose(got[f], max(s) / total, rel_tol=1e-9) for f, s in sums.items())


def test_files_of_numbers_and_banners_by_hand(spark):
    code = "import os\n\ndef f(a):\n    return a + 1\n" * 5
    files = {
        "src/rows.sql": "\n".join(f"INSERT INTO t_{i} VALUES ({i * 7919}, 'a37d3088d1df5c{i:02d}', {i * 13}.2714);" for i in range(40)),
        "src/table.py": "ROWS = {\n" + "".join(f"    {i * 7919}: (0.{i}4515, 0.89216, {i * 31}5527),\n" for i in range(1, 40)) + "}",
        "src/out.ts": "// Produced by classgen; hand edits are overwritten on the next build\n" + code,
        "src/set.sql": "INSERT INTO settings (name, val) VALUES ('token_count', '11');\n" + code, "src/a.py": code, "src/b.py": code + "# written by hand; edits welcome\n",
    }
    fm = spark.createDataFrame([("p", f) for f in files], "project_id string, file_path string")
    fc = spark.createDataFrame([("p", f, f) for f in files], "project_id string, file_path string, chunk_id string")
    c = spark.createDataFrame(list(files.items()), "chunk_id string, content string")
    got = {r.file_path: r.label for r in provenance.label_files(fm, fc, c).collect()}
    assert got == {"src/rows.sql": "blob", "src/table.py": "blob", "src/out.ts": "generated", "src/set.sql": "handwritten", "src/a.py": "handwritten", "src/b.py": "handwritten"}


def test_trees_cut_into_blocks_have_the_same_labels(spark):
    r = random.Random(5)
    names = ["src", "lib", "vendor", "dist", "a", "b", "generated", "node_modules"]
    paths = {"/".join(r.choice(names) for _ in range(r.randint(0, 6)) if True) for _ in range(150)}
    rows = [(g, (f"{d}/" if d else "") + f"{n}{i}.js") for g in "pq" for i, d in enumerate(sorted(paths)) for n in ("x", "y.min")]
    fm = spark.createDataFrame([*rows, ("p", "/".join(["deep"] * 300) + "/z.js")], "project_id string, file_path string")
    none = spark.createDataFrame([], "project_id string, file_path string, chunk_id string"), spark.createDataFrame([], "chunk_id string, content string")
    whole = {(x.project_id, x.file_path): (x.label, round(x.confidence, 9)) for x in provenance.label_files(fm, *none).collect()}
    for limit in (1, 4, 20):
        cut = {(x.project_id, x.file_path): (x.label, round(x.confidence, 9)) for x in provenance.label_files(fm, *none, block_dirs=limit).collect()}
        assert cut == whole, limit
    assert len(whole) == fm.count() and len({x[0] for x in whole.values()}) > 2


def test_small_trees_beside_one_that_is_cut(spark, monkeypatch):
    rows = [("p", f"d{i}/e/x{i}.js") for i in range(60)] + [(f"g{i}", "vendor/y.js") for i in range(12)]
    fm = spark.createDataFrame(rows, "project_id string, file_path string")
    none = spark.createDataFrame([], "project_id string, file_path string, chunk_id string"), spark.createDataFrame([], "chunk_id string, content string")
    monkeypatch.setattr(provenance, "SHARD_DIRS", 5)  # some groups have small trees only, which send nothing up
    got = {(x.project_id, x.file_path): x.label for x in provenance.label_files(fm, *none, block_dirs=20).collect()}
    assert got == {(g, p): "vendored" if g != "p" else "handwritten" for g, p in rows}
