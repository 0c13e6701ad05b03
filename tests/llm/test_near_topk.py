"""Near-duplicate components and top-k products against brute force."""

import re

import numpy as np
import pyarrow as pa
import pytest

from wattframe.llm import minmax, topk
from wattframe.llm.components import components
from wattframe.llm.text import text_buffers


def shingles(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k:k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def brute(texts, percent=85):
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(k) for k in range(len(sets))], [len(s) for s in sets]


def family(rng, n, words, change):
    base = rng.integers(0, 5000, words)
    out = []
    for _ in range(n):
        own = base.copy()
        at = rng.random(words) < change * rng.random()
        own[at] = rng.integers(5000, 9000, at.sum())
        out.append(" ".join(f"w{k}" for k in own))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(4)
    out = [None, "", "a", "A", "a b", "a b", "b a", " \t"]
    for n in (2, 3, 40, 60):
        out += family(rng, n, int(rng.integers(30, 200)), 0.12)
    return out + [" ".join(f"w{k}" for k in rng.integers(0, 9000, 50)) for _ in range(40)]


def test_shingle_sets_have_the_right_sizes(texts):
    hashes, splits = minmax.shingle_sets(*text_buffers(pa.array(texts)))
    assert np.diff(splits).tolist() == brute(texts)[1]
    sets = [shingles(t) for t in texts]
    own = [set(hashes[a:b].tolist()) for a, b in zip(splits[:-1], splits[1:], strict=True)]
    assert all(len(own[a] & own[b]) == len(sets[a] & sets[b]) for a in range(60) for b in range(a))


@pytest.mark.parametrize("block", [1024, 16])
def test_components_equal_brute_force(spark, texts, monkeypatch, block):
    monkeypatch.setattr(minmax, "BLOCK_SETS", block)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in minmax.near_duplicates(docs).collect()}
    roots, sizes = brute(texts)
    assert [got[k].component_id for k in range(len(texts))] == roots
    assert [got[k].n_shingles for k in range(len(texts))] == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert sorted(r.doc_id for r in minmax.one_of_each(docs).collect()) == sorted(set(roots))


def test_block_links_span_the_right_components():
    rng = np.random.default_rng(5)
    texts = family(rng, 50, 60, 0.3) + family(rng, 30, 80, 0.1)
    hashes, splits = minmax.shingle_sets(*text_buffers(pa.array(texts)))
    sets = [hashes[a:b] for a, b in zip(splits[:-1], splits[1:], strict=True)]
    links = minmax.block_links(sets)
    roots, _ = brute(texts)
    assert len(links) == len(texts) - len(set(roots)) and all(roots[a] == roots[b] for a, b in links)


def test_band_links_of_a_hot_key_take_no_window(spark):
    rows = [(k, [7, 100 + k // 2]) for k in range(3, 60)]
    got = minmax.band_links(spark.createDataFrame(rows, "node long, bands array<long>"))
    assert "Window" not in got._jdf.queryExecution().toString()
    firsts = {key: min(k for k, keys in rows if key in keys) for _, keys in rows for key in keys}
    assert sorted((r.a, r.b) for r in got.collect()) == sorted((firsts[key], k) for k, keys in rows for key in keys if firsts[key] != k)


def test_one_row_of_each_component_stays_for_repeated_and_null_ids(spark):
    words = [f"w{k}" for k in range(60)]
    near = [" ".join([*words, f"x{k}"]) for k in range(4)]
    far = [" ".join(f"{c}{k}" for k in range(30)) for c in "pq"]
    rows = [(1, near[0]), (1, near[1]), (None, near[2]), (None, far[0]), (None, far[0] + " more"), (5, far[1]), (5, far[1]), (None, None), (None, None)]
    stay = minmax.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), (r.text or "-")[0]) for r in stay) == [("1", "w"), ("5", "q"), ("None", "-"), ("None", "-"), ("None", "p")]


def test_near_duplicates_of_awkward_rows(awkward, nothing):
    got = minmax.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[2].component_id == 1 and not by_id[2].kept and by_id[1].kept
    assert all(by_id[k].component_id == k and by_id[k].n_shingles == 0 for k in (3, 4, 5))
    assert {(r.component_id, r.kept) for r in got if r.doc_id is None} == {(7, False), (None, False)}
    stay = minmax.one_of_each(awkward)
    assert stay.columns == awkward.columns and sorted(str(r.doc_id) for r in stay.collect()) == sorted(map(str, [1, 3, 4, 5, 7, 8, 9, 10, 11, 12, None]))
    assert minmax.near_duplicates(nothing).count() == 0 and minmax.one_of_each(nothing).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.range(500).selectExpr("(id * 37) % 501 AS a", "((id + 1) * 37) % 501 AS b").union(spark.createDataFrame([(900, 901), (901, 900)], "a long, b long"))
    got = {r.node: r.label for r in components(links).collect()}
    assert len(got) == 503 and len({got[k] for k in range(501)}) == 1 and got[900] == got[901] != got[0]


@pytest.mark.parametrize("n,k,spread", [(300, 7, 1.0), (300, 20, 0.05), (5, 20, 1.0)])
def test_block_top_equals_brute_force(n, k, spread):
    rng = np.random.default_rng(n)
    centers = rng.normal(0, 1, (5, 24))
    x = np.floor(64 * (centers[rng.integers(0, 5, n)] + spread * rng.normal(0, 1, (n, 24)))).astype(np.int64)
    x[3] = x[2]
    asks = np.arange(0, n, 3)
    for i, hit, score in topk.block_top(x[asks], x, asks, k):
        every = x @ x[asks[i]]
        order = sorted((j for j in range(n) if j != asks[i]), key=lambda j: (-every[j], j))[:k]
        assert hit.tolist() == order and score.tolist() == every[order].tolist()


def test_finer_bounds_are_made_for_survivors_alone():
    rng = np.random.default_rng(8)
    steps = rng.normal(0, 1, (400, 1)) + np.repeat(rng.normal(0, 0.5, (400, 4)), 16, axis=1) + rng.normal(0, 0.05, (400, 64))
    x, seen = np.floor(64 * steps).astype(np.int64), []
    list(topk.block_top(x[::20], x, np.arange(0, 400, 20), 5, seen))
    assert len(seen) == len(topk.SEGMENTS) + 1 and seen[0] == 20 * 400
    assert all(a >= b for a, b in zip(seen[:-1], seen[1:], strict=True)) and seen[1] < seen[0] / 2 and seen[-1] < seen[0] / 4


def test_top_products_of_awkward_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 7)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(6)
    rows = [(k, [float(v) for v in rng.normal(0, 1, 6)], "x", 1) for k in range(40)]
    rows += [(0, rows[0][1], "x", 1), (20, rows[20][1][:4], "x", 1), (50, None, "x", 1), (60, [1.0, None], "x", 1), (80, [float("nan")] * 6, "x", 1), (100, [float("inf")] * 6, "x", 1),
             (None, [1.0] * 6, "x", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string, score int")
    good = [(i, np.pad(np.floor(64 * np.array(v)).astype(int), (0, 6 - len(v)))) for i, v, *_ in rows[:42]]
    want = []
    for a, (i, v) in enumerate(good):
        if i % 20 == 0:
            every = sorted((-int(v @ w), j, b) for b, (j, w) in enumerate(good) if b != a)[:5]
            want += [(i, r + 1, j, -s) for r, (s, j, _) in enumerate(every)]
    got = [tuple(r) for r in topk.top_products(df, df["vec_id"] % 20 == 0, k=5).collect()]
    assert sorted(got) == sorted(want)
    assert topk.top_products(df.limit(0), df["vec_id"] % 20 == 0).count() == 0
