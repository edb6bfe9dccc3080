import fnmatch
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import glob as G
from palimpsest.functions import text as T
from palimpsest.operators import fts, fusion, vector


@pytest.mark.parametrize("q, mode, want", [("foo bar", "strict", '"foo" AND "bar"'), ("foo bar", "any", '"foo" OR "bar"'), ('"foo bar" baz', "strict", '"foo bar" AND "baz"'), ("foo not bar", "strict", '"foo" NOT "bar"'), ("", "any", ""), ("c++ (x)", "strict", '"c++" AND "x"')])
def test_parse(q, mode, want):
    assert fts.render(fts.parse(q, mode)) == want


def test_parse_limits():
    with pytest.raises(ValueError):
        fts.parse(" ".join(f"t{i}" for i in range(51)))
    with pytest.raises(ValueError):
        fts.parse("a", "other")
    assert len(fts.parse("x" * 500)[0].text) == 128


def test_boolean_precedence_and_nulls(spark):
    df = spark.createDataFrame([(1, "lorem ipsum"), (2, "hello café"), (3, "hello"), (4, None), (5, "")], "id int, t string")
    ids = lambda q, m="strict": sorted(r.id for r in fts.bm25(df, "id", "t", fts.parse(q, m)).collect())
    assert ids("lorem or hello and cafe") == [1, 2]
    assert ids("hello not cafe") == [3]
    assert ids("+++ hello") == [] and ids("+++ hello", "any") == [2, 3]
    assert ids("") == [] and ids("hello cafe", "phrase") == [2]
    assert fts.bm25(df.limit(0), "id", "t", fts.parse("a")).count() == 0


def test_windows_put_the_text_together(spark):
    texts = ["", None, "  ", "one", " ".join(f"w{i}" for i in range(700)), "a  b\n\nc\t" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    rows = df.select("id", F.explode(T.windows(F.col("t"), 60, 10)).alias("w")).collect()
    for i, t in enumerate(texts):
        got = [r.w for r in rows if r.id == i]
        words = (t or "").split()
        assert bool(got) == bool(words)
        if words:
            whole = got[0].content.split()
            for w in got[1:]:
                part = w.content.split()
                assert part[:10] == whole[-10:]
                whole += part[10:]
            assert whole == words and all(len(w.content.split()) <= 60 for w in got)


def test_small_functions(spark):
    df = spark.createDataFrame([("Fix: add tests", "  My Proj!! ", "CON.x", "../etc/passwd"), (None, "--", "a-b_1", None)], "m string, n string, p string, s string")
    rows = df.select(T.commit_tags(F.col("m")).alias("m"), T.slug(F.col("n")).alias("n"), T.valid_project_id(F.col("p")).alias("p"), T.sanitize_section(F.col("s")).alias("s")).collect()
    assert sorted(rows[0].m) == ["feat", "fix", "test"] and rows[0].n == "my_proj" and not rows[0].p and rows[0].s == "etcpasswd"
    assert rows[1].n == "project" and rows[1].p and rows[1].s is None
    one = spark.range(1).select(T.trim_content(F.lit("x" * 10), 4).alias("a"), T.trim_content(F.lit("x" * 10), 0).alias("b"), T.truncate_tokens(F.lit("a b  c "), 2).alias("c"), T.truncate_tokens(F.lit("a b "), 2).alias("d"), T.make_id(F.lit("a")).alias("e")).first()
    assert one.a == "xxxx…" and one.b == "x" * 10 and one.c == "a b" and one.d == "a b "
    import hashlib

    assert one.e == hashlib.sha256(b"a\0").hexdigest()


def test_metadata(spark):
    df = spark.createDataFrame([('{"type": "x"}',), ("{",), ("[]",), (None,), ("",)], "m string")
    got = [r.m for r in df.select(T.safe_metadata(F.col("m")).alias("m")).collect()]
    assert got[0] == '{"type": "x"}' and "private" in got[1] and "private" in got[2] and got[3] == got[4] == "{}"


PATHS = ["node_modules/a.js", "x/node_modules/a.js", "a.log", "x/a.log", "src/a.py", "dist/x.js", "a/dist/x.js", ".DS_Store", "a/.DS_Store", "a\\b.log", "weird[1].log", None]


def test_ignored(spark):
    got = [r.i for r in spark.createDataFrame([(p,) for p in PATHS], "p string").select(G.is_ignored(F.col("p")).alias("i")).collect()]

    def want(p):
        if p is None:
            return None
        name = p.rsplit("/", 1)[-1]
        return any(fnmatch.fnmatchcase(p, g) or fnmatch.fnmatchcase(name, g) or fnmatch.fnmatchcase(name, re.sub(r"^(\*\*/)+", "", g)) for g in G.IGNORED)

    assert got == [want(p) for p in PATHS] and got[0] is False and got[1] is True


@settings(max_examples=100, deadline=None)
@given(st.text("ab*?[]!./", max_size=8), st.text("ab./", max_size=8))
def test_glob(pattern, path):
    try:
        mine = bool(re.match(G.to_regex(pattern), path))
    except re.error:
        return
    if "[" not in pattern:
        assert mine == fnmatch.fnmatchcase(path, pattern)


def test_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(900, None), (901, [1.0]), (902, [0.0] * 8), (903, [float("nan")] * 8)]
    rows += [(400 + i, rows[i][1]) for i in range(20)]  # ties
    df = spark.createDataFrame(rows, "id long, v array<double>")
    q = rows[0][1]
    a, b, c = ([(r.id, r.score, r.vec_rank) for r in x.orderBy("vec_rank").collect()] for x in (vector.knn(df, "id", "v", q, 10), vector.knn_arrow(df, "id", "v", q, 10), vector.knn_sharded(df, "id", "v", q, 10, 3)))
    assert a == b == c and len(a) == 10
    ivf = {r.id for r in vector.knn_ivf(df, "id", "v", q, 10, 20, 12).collect()}
    assert len(ivf & {x[0] for x in a}) >= 8
    assert vector.knn_arrow(df.limit(0), "id", "v", q, 10).count() == 0
    assert vector.shard_count(999_999) == 1 and vector.shard_count(1_000_001) == 5


def test_ivf_recall_with_its_own_parameters(spark):
    import numpy as np

    for sf in ("sf0.01", "sf0.1"):
        df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
        rows, centres = vector.ivf_cells(df, "vec_id", "embedding", 64)
        pdf = rows.select("vec_id", "embedding", "prediction").orderBy("vec_id").toPandas()
        x, cell = np.array(pdf["embedding"].tolist(), float), pdf["prediction"].to_numpy()
        recall = {}
        for probes in (16, vector.NPROBE):
            recall[probes] = []
            for i in range(0, len(x), 6):
                top = np.lexsort((np.arange(len(x)), -np.round(x @ x[i], 6)))[:20]
                recall[probes].append(np.isin(cell[top], np.argsort(-(centres @ x[i]))[:probes]).mean())
        print(sf, {p: (round(np.mean(r), 3), min(r), r[0]) for p, r in recall.items()})
        assert np.mean(recall[vector.NPROBE]) >= 0.9
        q = x[0].tolist()
        exact = {r.vec_id for r in vector.knn_arrow(df, "vec_id", "embedding", q, 20).collect()}
        assert len(exact & {r.vec_id for r in vector.knn_ivf(df, "vec_id", "embedding", q, 20).collect()}) >= 18


def test_fusion(spark):
    lex = spark.createDataFrame([("a", 1), ("b", 2)], "id string, lex_rank int")
    vec = spark.createDataFrame([("b", 1), ("c", 2)], "id string, vec_rank int")
    got = {r.id: r.score for r in fusion.rrf(lex, vec, "id").collect()}
    back = {r.id: r.score for r in fusion.rrf(vec.withColumnRenamed("vec_rank", "lex_rank"), lex.withColumnRenamed("lex_rank", "vec_rank"), "id").collect()}
    assert got == back == {"a": round(1 / 61, 6), "b": round(1 / 62 + 1 / 61, 6), "c": round(1 / 62, 6)}
    cand = spark.createDataFrame([("a", [1.0, 0.0], 0.9), ("b", [1.0, 0.01], 0.89), ("c", [0.0, 1.0], 0.5)], "id string, v array<double>, rel double")
    order = lambda w: [r.id for r in fusion.mmr(cand, "id", "v", "rel", 3, w).orderBy("mmr_pos").collect()]
    assert order(1.0) == ["a", "b", "c"] and order(0.5) == ["a", "c", "b"]
    assert [r.id for r in fusion.mmr(cand, "id", "v", "rel", 9, 1.0).collect()] == ["a", "b", "c"]
