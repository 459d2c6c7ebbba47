import numpy as np
import pytest

from chainloom.llm import embedding_dedup as e
from chainloom.llm.shared import Scratch
from tests.llm import brute


def corpus(kind="float"):
    rng = np.random.default_rng(3)
    rows = []
    for label, n in ((0, 150), (1, 60), (2, 5)):
        base = rng.normal(size=(n // 5 + 1, 16))
        for i in range(n):
            v = base[rng.integers(len(base))] + rng.normal(size=16) * rng.choice([0, 0.05, 0.1, 0.14])
            rows.append((len(rows) * 3, (v * rng.choice([1, 7])).astype("f4").astype(float).tolist(), label))
    rows += [(900 + i, rows[0][1], 0) for i in range(40)] + [(990, rows[0][1], None), (991, None, 1), (992, [0.0] * 16, 1), (993, [1.0, None], 1), (994, [float("nan")] * 16, 1), (995, [], 1), (996, rows[0][1][:5], 0), (997, [float("inf")] * 16, 0)]
    return rows


def expected(rows, c=0.98):
    good = {}
    for i, v, label in rows:
        if label is not None and v and None not in v and np.isfinite(v).all() and any(v):
            good[i] = (label, np.array(v) / np.linalg.norm(v))
    links = [(a, b) for a, (la, x) in good.items() for b, (lb, y) in good.items() if a < b and la == lb and len(x) == len(y) and x @ y >= c]
    n = {i: 0 for i, *_ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    up = brute.components(list(n), links)
    return sorted((i, n[i], up[i], up[i] == i) for i in n)


@pytest.mark.parametrize("leaf", [1024, 20])
def test_matches_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(e, "LEAF", leaf)
    monkeypatch.setattr(e, "CHILDREN", 4)
    rows = corpus()
    kind = "float" if leaf > 100 else "double"
    got = e.near_duplicates(spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label int"))
    assert sorted(map(tuple, got.collect())) == expected(rows)


def test_tree_prunes_and_finds_all():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 8))
    raw = np.repeat(base, 12, axis=0) + rng.normal(size=(360, 8)) * 0.06
    x = e._unit(raw)
    tree = e.CoverTree(x, 0.05)
    for level in range(tree.depth()):
        order, starts, counts = tree.children[level]
        assert sorted(order.tolist()) == list(range(len(tree.centers[level + 1]))) and counts.sum() == len(order)
    i, j = e.tree_links(tree, tree, raw, raw, 0.98, True)
    assert sorted(zip(i.tolist(), j.tolist())) == [(a, b) for a in range(360) for b in range(a + 1, 360) if x[a] @ x[b] >= 0.98]
    half = e.CoverTree(x[:100], 0.05)
    i, j = e.tree_links(half, tree, raw[:100], raw, 0.98, False)
    assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a in range(100) for b in range(360) if x[a] @ x[b] >= 0.98}


def test_empty_and_unsplittable(spark, monkeypatch):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int, node int")
    assert e.near_duplicates(none).count() == 0
    monkeypatch.setattr(e, "LEAF", 4)
    rows = [(i, [1.0, 1e-6 * i], 1) for i in range(30)]
    got = e.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"))
    assert {(r.n_links, r.component_id) for r in got.collect()} == {(29, 0)}


def test_balls_cover_what_is_below(spark, monkeypatch):
    monkeypatch.setattr(e, "LEAF", 8)
    monkeypatch.setattr(e, "CHILDREN", 3)
    rng = np.random.default_rng(9)
    x = e._unit(np.concatenate([rng.normal(size=(40, 6)), rng.normal(size=6) + 0.05 * rng.normal(size=(80, 6))]))
    points = spark.createDataFrame([(i, 1, bytearray(v.astype("<f8").tobytes()), 7) for i, v in enumerate(x)], "pid bigint, n bigint, vec binary, root bigint")
    leaves, tree = e._grow(points, "<f8", Scratch(spark, "test"))
    leaf, up, ball = {r.pid: r.leaf for r in leaves.collect()}, {}, {}
    for r in tree.collect():
        up[r.node], ball[r.node] = r.parent, (np.array(r.center), r.radius)
    assert sorted(leaf) == list(range(120)) and len({len(list(path(up, k))) for k in leaf.values()}) > 1  # leaves of several depths
    for i, k in leaf.items():
        for node in path(up, k):
            assert np.linalg.norm(x[i] - ball[node][0]) <= ball[node][1]


def path(up, node):
    while node in up:
        yield node
        node = up[node]


def test_repeated_ids_and_planted_pairs_across_leaves(spark, monkeypatch):
    monkeypatch.setattr(e, "LEAF", 8)
    monkeypatch.setattr(e, "VISITORS", 5)
    monkeypatch.setattr(e, "PARTNERS", 2)
    got = e.near_duplicates(spark.createDataFrame([(7, [1.0, 0.0], 1), (7, [0.0, 1.0], 1), (8, [1.0, 0.001], 1), (9, [0.001, 1.0], 1)], "vec_id bigint, embedding array<float>, label int"))
    assert sorted(map(tuple, got.collect())) == [(7, 1, 7, True), (7, 1, 7, True), (8, 1, 7, False), (9, 1, 7, False)]
    rng = np.random.default_rng(10)
    a = rng.normal(size=(150, 5))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([a, a + 0.08 * rng.normal(size=a.shape)]))]
    got = e.near_duplicates(spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id bigint, embedding array<double>, label int, pid int, n int"))
    assert sorted(map(tuple, got.collect())) == expected(rows)
