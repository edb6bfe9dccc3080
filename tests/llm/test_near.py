import random
from collections import Counter
from itertools import combinations

import numpy as np

from palimpsest.llm import neardup, neighbors, together


def shingle(t, k):
    w = t.split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def corpus():
    random.seed(3)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(40):
        base = [random.choice(words) for _ in range(random.randint(30, 120))]
        texts.append(base)
        for _ in range(random.randint(0, 4)):
            new = list(base)
            for _ in range(random.randint(1, 12)):
                i = random.randrange(len(new))
                new[i : i + 1] = random.choice([[], ["ins", new[i]], [random.choice(words)]])
            texts.append(new)
    return [(f"t{i}", random.choice([" ", "\n", "  "]).join(t)) for i, t in enumerate(texts)]


def test_near_pairs_equal_brute_force(spark):
    rows = corpus()
    rows += [("copy1", rows[0][1]), ("copy2", rows[0][1]), ("copy3", rows[0][1].replace(" ", "\t")), ("short", "a b c"), ("none", None), ("empty", ""), (None, rows[1][1]), rows[2]]
    df = spark.createDataFrame([(*r, "z") for r in rows], "id string, text string, cls string")
    members, links = neardup.near_classes(df, "id", "text", "0.7", 3, 10)
    got = {(r.a, r.b) for r in neardup.near_pairs(members, links).collect()}
    sets = {i: shingle(t, 3) for i, t in rows if i and t and len(t.split()) >= 10}
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])}
    assert got == want and len(want) > 20
    grp = {r.key: r.grp for r in neardup.groups(members, links).collect()}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        parent[root(a)] = root(b)
    assert all((grp[a] == grp[b]) == (root(a) == root(b)) for a, b in combinations(sorted(sets), 2))


def test_hot_shingles_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 5)
    rows = [(f"h{i:02d}", "the same licence header stands here " + f"u{i // 4} v{i // 4} w{i // 2} x{i}") for i in range(60)] + corpus()
    df = spark.createDataFrame(rows, "id string, text string")
    got = {(r.a, r.b) for r in neardup.near_pairs(*neardup.near_classes(df, "id", "text", "0.5", 2, 5)).collect()}
    sets = {i: shingle(t, 2) for i, t in rows if len(t.split()) >= 5}
    assert got == {(a, b) for a, b in combinations(sorted(sets), 2) if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])} and len(got) > 60


def test_pivot_table_bounds_and_discards():
    import pyarrow as pa

    from palimpsest.llm.shingles import shingles

    texts = [t for _, t in corpus()]
    s = shingles(pa.array(texts), 3, 10)
    sets = [set(s.hash[s.doc == i].tolist()) for i in range(len(s.docs))]
    longs = neardup.pivot_table(s)
    counts = np.array([[(int(x[i]) >> 4 * j) & 15 for x in longs for j in range(neardup.PER_LONG)] for i in range(len(s.docs))])
    kept = pairs = 0
    for i, j in combinations(range(len(sets)), 2):
        apart = np.abs(counts[i] - counts[j]).sum()
        assert apart <= len(sets[i] ^ sets[j])
        total = len(sets[i]) + len(sets[j])
        pairs += 1
        kept += (total - apart) * 17 >= total * 7 * 2  # 7/17 of both sizes is a similarity of 0.7
    assert kept < pairs / 3


def test_exact_threshold(spark):
    # 17 shared of 20 and 24 in all: 10/10 against 7/10 exactly
    a = [f"a{i}" for i in range(37)]
    for cut in range(1, 12):
        b = a[:-cut] + [f"b{i}" for i in range(cut)]
        sa, sb = shingle(" ".join(a), 3), shingle(" ".join(b), 3)
        df = spark.createDataFrame([("x", " ".join(a)), ("y", " ".join(b))], "id string, t string")
        if cut in (3, 4, 5, 6, 7):
            _, links = neardup.near_classes(df, "id", "t", "0.7", 3, 30)
            assert links.count() == int(10 * len(sa & sb) >= 7 * len(sa | sb))


def test_exact_threshold_of_long_texts(spark):
    # 140,000 shared of 200,000: the threshold exactly, in sets whose hashes' upper halves collide
    words = [f"w{i}" for i in range(200_000)]
    df = spark.createDataFrame([("x", " ".join(words[:170_000])), ("y", " ".join(words[:140_000] + words[170_000:])), ("z", " ".join(words[1:140_000] + words[170_000:] + ["v"]))], "id string, t string")
    m, links = neardup.near_classes(df.where("id <> 'z'"), "id", "t", "0.7", 1, 1)
    assert links.count() == 1
    m, links = neardup.near_classes(df.where("id <> 'y'"), "id", "t", "0.7", 1, 1)
    assert links.count() == 0


def test_near_empty(spark):
    df = spark.createDataFrame([], "id string, text string")
    m, links = neardup.near_classes(df, "id", "text")
    assert neardup.near_pairs(m, links).count() == 0 and neardup.groups(m, links).count() == 0


def brute(rows, k, dim):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = min(ok.get(i, v), v)
    ids = sorted(ok)
    x = np.array([ok[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 12)
    np.fill_diagonal(s, -9)
    return {(ids[i], ids[j]) for i in range(len(ids)) for j in np.lexsort((ids, -s[i]))[: min(k, len(ids) - 1)]}


def test_neighbors_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    rows = [(f"v{i}", [float(np.float32(x)) for x in centres[i % 30] + 0.4 * rng.normal(size=16)]) for i in range(900)]
    rows += [("none", None), ("empty", []), ("zero", [0.0] * 16), ("nan", [float("nan")] * 16), ("short", [1.0, 2.0]), (None, rows[0][1]), rows[5]]
    df = spark.createDataFrame(rows, "id string, v array<float>")
    out = neighbors.nearest(df, "id", "v", 5, 16).collect()
    got, want = {(r.id, r.neighbour) for r in out}, brute(rows, 5, 16)
    assert len(got & want) >= 0.95 * len(want) and len(out) == len(got) == 5 * 900


def test_neighbors_copies_and_ties(spark):
    rows = [(f"c{i:02d}", [1.0, 2.0]) for i in range(20)] + [("d", [2.0, 4.0]), ("e", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    got = {(r.id, r.neighbour) for r in neighbors.nearest(df, "id", "v", 3, 2).collect()}
    assert got == brute(rows, 3, 2)


def test_neighbors_ties_of_scaled_copies(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(3, 8))
    rows = [(f"g{i:03d}", [float(x) for x in base[i % 3] * rng.uniform(0.1, 9)]) for i in rng.permutation(60)]
    rows += [(f"q{i}", [float(x) for x in base[i % 3] + 0.01 * rng.normal(size=8)]) for i in range(6)]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    got = {(r.id, r.neighbour) for r in neighbors.nearest(df, "id", "v", 5, 8).collect()}
    assert got == brute(rows, 5, 8)
    # The same with files in blocks and a footrule cut narrower than the copies.
    monkeypatch.setattr(neighbors, "BLOCK", 16)
    assert {(r.id, r.neighbour) for r in neighbors.nearest(df, "id", "v", 5, 8).collect()} == brute(rows, 5, 8)


def test_search_block_settles_ties_before_each_cut():
    n, ids = 400, np.arange(400)
    v = neighbors.normed(np.random.default_rng(8).normal(size=8) * np.random.default_rng(9).uniform(0.1, 9, (n, 1)))
    perm = np.tile(np.arange(4, dtype=np.int16), (n, 1))
    for rerank in (2, 200):
        q, x, cos = neighbors.search_block(ids, perm, v, ids, perm, v, 5, rerank)
        got = {i: set(x[q == i].tolist()) for i in range(n)}
        assert all(len(got[i]) >= 5 and set(sorted(set(range(6)) - {i})[:5]) <= got[i] for i in range(n)) and set(cos) == {1.0}


def test_neighbors_long_file_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(f"v{i}", [float(x) for x in np.ones(8) + 0.01 * rng.normal(size=8)]) for i in range(300)]
    monkeypatch.setattr(neighbors, "BLOCK", 64)
    df = spark.createDataFrame(rows, "id string, v array<double>")
    got = {(r.id, r.neighbour) for r in neighbors.nearest(df, "id", "v", 3, 8).collect()}
    assert len(got & brute(rows, 3, 8)) >= 0.9 * 900


def test_nearness_is_the_footrule():
    rng = np.random.default_rng(3)
    q, x = (np.array([rng.permutation(30)[:6] for _ in range(n)], np.int16) for n in (20, 25))
    near = neighbors.nearness(q, x)
    for i in range(20):
        for j in range(25):
            rank = lambda p, v: p.tolist().index(v) if v in p else 6
            footrule = sum(abs(rank(q[i], v) - rank(x[j], v)) for v in set(q[i]) | set(x[j]))
            assert footrule == 2 * (21 - near[i, j])


def test_footrule_decides_and_recall_holds():
    # One file of 3,000 vectors: of 1,800 that footrule keeps the five nearest are found.
    rng = np.random.default_rng(5)
    v = neighbors.normed(rng.normal(size=(40, 24))[rng.integers(0, 40, 3000)] + 0.5 * rng.normal(size=(3000, 24)))
    pivots = neighbors.fit_pivots(v, 110)
    perm = np.argsort(-(v @ pivots.T), axis=1)[:, : neighbors.PERMUTATION].astype(np.int16)
    ids = np.arange(3000)
    q, x, _ = neighbors.search_block(ids[:300], perm[:300], v[:300], ids, perm, v, 5)
    cos = v[:300] @ v.T
    cos[np.arange(300), np.arange(300)] = -9
    want = np.argsort(-cos, axis=1)[:, :5]
    found = [len(set(x[q == i].tolist()) & set(want[i].tolist())) for i in range(300)]
    assert neighbors.SHARE * 3000 > neighbors.RERANK * 5 and sum(found) >= 0.95 * 1500


def test_neighbors_of_very_long_files(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    rows = [(f"v{i}", [float(np.float32(x)) for x in centres[i % 30] + 0.4 * rng.normal(size=16)]) for i in range(900)]
    df = spark.createDataFrame(rows, "id string, v array<float>")
    monkeypatch.setattr(neighbors, "SPLIT", 40)
    out = neighbors.nearest(df, "id", "v", 5, 16).collect()
    assert len({(r.id, r.neighbour) for r in out} & brute(rows, 5, 16)) >= 0.9 * 4500 and len({r.id for r in out}) == 900


def test_neighbors_are_the_same_however_files_are_cut(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(f"v{i}", [float(np.float32(x)) for x in rng.normal(size=12)]) for i in range(900)]
    df = spark.createDataFrame(rows, "id string, v array<float>")
    monkeypatch.setattr(neighbors, "PIVOTS_PER_ROOT", 0.1)  # long files, in which footrule decides
    got = lambda: {(r.id, r.neighbour, r["rank"], r.similarity) for r in neighbors.nearest(df, "id", "v", 5, 12).collect()}
    whole = got()
    for name, size in (("BLOCK", 64), ("SPLIT", 40)):
        with monkeypatch.context() as m:
            m.setattr(neighbors, name, size)
            assert got() == whole, name


def test_neighbors_few_rows(spark):
    df = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "id string, v array<double>")
    assert {(r.id, r.neighbour) for r in neighbors.nearest(df, "id", "v", 5).collect()} == {("a", "b"), ("b", "a")}
    assert neighbors.nearest(df.limit(0), "id", "v", 5).count() == 0


def test_together_equals_counting(spark, monkeypatch):
    monkeypatch.setattr(together, "BLOCK", 4)
    monkeypatch.setattr(together, "RUN", 50)
    random.seed(5)
    rows = [(random.choice(["p", "q", None]), f"r{i}", [random.choice(["a", "b", "c", "d", "e", "é", None] + [f"x{j}" for j in range(12)]) for _ in range(random.randint(0, 14))]) for i in range(160)]
    rows += [("p", "nul", None), ("p", None, ["a", "b"]), rows[0]]
    df = spark.createDataFrame([(*r, 1) for r in rows], "g string, r string, items array<string>, n int")
    got = {(x.g, x.item_a, x.item_b): (x.n, x.n_a, x.n_b, x.n_ab) for x in together.together(df, ["g"], "r", "items", 2, 1.1).collect()}
    sets = {(g, r): {i for i in items if i is not None} for g, r, items in rows if r is not None and items}
    n, ni, nab = Counter(), Counter(), Counter()
    for (g, _), s in sets.items():
        if s:
            n[g] += 1
            for a in s:
                ni[g, a] += 1
            for a, b in combinations(sorted(s), 2):
                nab[g, a, b] += 1
    want = {(g, a, b): (n[g], ni[g, a], ni[g, b], c) for (g, a, b), c in nab.items() if c >= 2 and c * n[g] >= 1.1 * ni[g, a] * ni[g, b]}
    assert got == want and want
    assert together.together(df.limit(0), ["g"], "r", "items").count() == 0
