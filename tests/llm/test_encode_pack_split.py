import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import cutting, encode, pack
from palimpsest.llm.vocab import encoder, splitter

PARTS = ["a", "B", " ", "  ", "\n", "'", "'s", "1", "é", "日本", "!", "\t", "\r\n", "ll", "<|endoftext|>", "\u200b", "e\u0301", "🎉"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=120), st.sampled_from([1, 3, 8, 50]))
def test_tree_equals_direct(parts, leaf):
    text, enc = "".join(parts), encoder()
    ids = encode.encode(text, enc, splitter(), leaf)
    assert ids == enc.encode_ordinary(text)
    assert encode.decode(ids, enc, 4).decode() == text


def test_long_runs():
    enc, pat = encoder(), splitter()
    for text in ("a" * 50_000, " " * 50_000, ("word " * 9000).strip()):
        assert encode.encode(text, enc, pat) == enc.encode_ordinary(text)


def test_encode_frame(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (1, "hello world", "x"), (None, "a", "x")], "id long, text string, ids string")
    rows = sorted(((r.id or 0), r.ids) for r in encode.encode_texts(df, "id", "text").collect())
    assert rows[1] == rows[2] == (1, encoder().encode_ordinary("hello world")) and rows[3] == (2, []) and rows[4] == (3, [])
    assert encode.encode_texts(df.limit(0), "id", "text").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=200))
def test_packing_bound(sizes):
    z = np.array(sizes)
    bins = pack.best_fit_decreasing(z, 100)
    fill = np.bincount(bins, weights=z)
    assert fill.max() <= 100 and fill.min() > 0
    bound = pack.lower_bound(z, 100)
    assert -(-z.sum() // 100) <= bound <= len(fill) <= 11 / 9 * bound + 1


def test_bound_beats_area():
    assert pack.lower_bound(np.array([51] * 10), 100) == 10


def test_pack_frame(spark):
    random.seed(1)
    rows = [(i, random.randint(1, 900)) for i in range(400)] + [(1000, 5000), (1001, 2048), (1002, 4096), (None, 5), (1003, None), (1004, 0), (1000, 5000)]
    df = spark.createDataFrame(rows, "id long, size long")
    out = pack.pack(df, "id", "size", 2048, group_items=60).toPandas()
    assert out.groupby("container_id").n_tokens.sum().max() <= 2048
    want = {i: s for i, s in rows if i is not None and s}
    assert out.groupby("id").n_tokens.sum().to_dict() == want
    assert (out[out.id < 1000].groupby("id").size() == 1).all()
    assert sorted(out[out.id == 1000].n_tokens) == [904, 2048, 2048] and sorted(out[out.id == 1002].n_tokens) == [2048, 2048]
    assert out.container_id.nunique() <= -(-sum(want.values()) // 2048) + 2
    assert pack.pack(df.limit(0), "id", "size").count() == 0


def test_certificates(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([700, 683, 1365, 900, 500, 60])) for i in range(600)] + [(900, 5000), (901, None), (901, 3)]
    df = spark.createDataFrame(rows, "id long, size long")
    for group_items in (100, 20_000):  # with rounds between groups, and one group alone
        placed, proof = pack.pack_certified(df, "id", "size", 2048, group_items)
        placed, proof = placed.toPandas(), proof.toPandas()
        assert placed.groupby("container_id").n_tokens.sum().max() <= 2048
        whole = proof[proof["round"] == -1].iloc[0]
        assert whole.containers == placed.container_id.nunique() == proof[proof["round"] >= 0].kept.sum() + 2 and whole["items"] == len(placed)
        assert (proof.containers >= proof.bound).all() and (proof.certified == (proof.containers == proof.bound)).all()
        assert whole.bound >= -(-placed.n_tokens.sum() // 2048)
    assert pack.pack_certified(df.limit(0), "id", "size")[1].count() == 0


def test_exchange_closes_gaps_that_best_fit_leaves():
    rng = np.random.default_rng(2)
    better = 0
    for _ in range(60):
        sizes = rng.integers(200, 1200, 90)
        bound = pack.lower_bound(sizes, 2048)
        bins = pack.best_fit_decreasing(sizes, 2048)
        new = pack.exchange(sizes, bins, 2048, bound)
        assert np.bincount(new, weights=sizes).max() <= 2048 and bound <= new.max() + 1 <= bins.max() + 1
        better += new.max() < bins.max()
    assert better > 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=7))
def test_bound_is_never_above_the_best_packing(sizes):
    def best(rest, rooms):
        if not rest:
            return len(rooms)
        out = best(rest[1:], [*rooms, 12 - rest[0]])
        for i in {r: i for i, r in enumerate(rooms) if r >= rest[0]}.values():
            out = min(out, best(rest[1:], [*rooms[:i], rooms[i] - rest[0], *rooms[i + 1 :]]))
        return out

    assert pack.lower_bound(np.array(sizes), 12) <= best(sizes, [])


def check(text, limit=20, overlap=4):
    ps = cutting.pieces(text, limit, overlap)
    assert "".join(text[b:e] for _, b, e, _, _ in ps) == text
    for i, (s, b, e, n, _) in enumerate(ps):
        words = cutting.TOKEN.findall(text[s:e])
        assert len(words) == n <= limit
        if i:
            before = cutting.TOKEN.findall(text[ps[i - 1][0] : ps[i - 1][2]])
            assert cutting.TOKEN.findall(text[s:b]) == before[-overlap:]
    return ps


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["w", "x. ", " ", "\n", "\n\n", "# h\n", "def f", ", "]), max_size=400))
def test_pieces(parts):
    check("".join(parts))


def test_boundaries():
    text = "\n\n".join(" ".join(f"w{i}" for i in range(15)) + "." for _ in range(4))
    assert [p[4] for p in check(text)] == ["paragraph"] * 3 + ["end"]
    assert [p[4] for p in check("w " * 50)][:2] == ["word", "word"]


def test_split_frame(spark):
    long = "one two three. " * 300
    df = spark.createDataFrame([("a", long, 1), ("a", long, 2), ("b", "short", 1), ("c", None, 1), ("d", "", 1), (None, long, 1)], "id string, text string, piece int")
    rows = cutting.split_oversized(df, "id", "text").collect()
    assert {r.id for r in rows} == {"a"} and len({r.piece_no for r in rows}) == len(rows)
    assert "".join(r.piece[r.body_start :] for r in sorted(rows, key=lambda r: r.piece_no)) == long
    assert cutting.split_oversized(df.limit(0), "id", "text").count() == 0
    with pytest.raises(ValueError):
        cutting.pieces("w " * 50, 10, 10)
