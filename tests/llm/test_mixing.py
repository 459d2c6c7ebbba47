import math
from collections import defaultdict

import pytest

from chainloom.llm import mixing, queries
from chainloom.llm.mixing import mix
from tests.llm.brute import SPACED


def targets(sizes, limit=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in stopped]
        left = total - sum(stopped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > limit * sizes[s]]
        if not over:
            return stopped | share
        stopped |= {s: limit * sizes[s] for s in over}


def test_targets_and_rounding(spark):
    rows = [(i, "w \x0b" * (1 + i * 7 % 50), ["a", "B", "é", None, "tiny", "zz"][i % 6 if i % 6 != 4 or i < 8 else 0]) for i in range(600)]
    rows += [(1000 + i, "same text here", "hot") for i in range(700)] + [(2000, None, "a"), (2001, "", "empty"), (2002, "x", None), (2002, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mix(docs).collect()
    assert sorted((r.doc_id, r.size) for r in got) == sorted((d, len(SPACED.findall(t or ""))) for d, t, _ in rows)
    source = {d: s for d, _, s in rows}
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        assert math.floor(r.rate + 1e-6) <= r.copies <= math.ceil(r.rate - 1e-6)
    want = targets(dict(sizes))
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]] and abs(r.target - want[source[r.doc_id]]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 4 + 1e-3 * want[s], (s, taken[s], want[s])
    optimal(got, source, want, sizes)
    assert any(want[s] == 3 * sizes[s] > 0 for s in sizes)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix(docs.repartition(7)).collect()), key=str)


def optimal(got, source, want, sizes):
    """Rates balance their source's words, and log rate is linear in size below the limit: the dual's optimum."""
    for s in sizes:
        own = sorted({(r.size, r.rate) for r in got if source[r.doc_id] == s and r.size})
        assert abs(sum(r.rate * r.size for r in got if source[r.doc_id] == s) - want[s]) <= 1e-4 * max(want[s], 1)
        free = [(n, math.log(r) / n) for n, r in own if r < 3 - 1e-9]
        assert all(abs(slope - free[0][1]) < 1e-9 for _, slope in free)
        assert all(math.log(3) <= free[0][1] * n + 1e-9 for n, r in own if r >= 3 - 1e-9 and free)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_on_documents(spark, sf):
    d = f"/root/testdata/{sf}"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source").collect()}
    got = queries.QUERIES["op2_mix_sources"](spark, d).collect()
    size = {i: len(SPACED.findall(r.text or "")) for i, r in docs.items()}
    sizes = defaultdict(int)
    for i, r in docs.items():
        sizes[r.source] += size[i]
    want, taken = targets(dict(sizes)), defaultdict(int)
    assert sorted((r.doc_id, r.size, r.source_size) for r in got) == sorted((i, size[i], sizes[docs[i].source]) for i in docs)
    for r in got:
        assert abs(r.target - want[docs[r.doc_id].source]) < 1e-6 * max(1, r.target)
        assert math.floor(r.rate + 1e-6) <= r.copies <= math.ceil(r.rate - 1e-6) and r.taken == r.copies * r.size
        taken[docs[r.doc_id].source] += r.taken
    largest = {s: max(size[i] for i, r in docs.items() if r.source == s) for s in want}
    assert all(abs(taken[s] - want[s]) <= max(0.001 * want[s], 0.25 * largest[s]) for s in want), {s: (taken[s], want[s]) for s in want}
    assert sum(abs(taken[s] - want[s]) for s in want) <= 0.01 * sum(want.values())


def test_equal_rows_nulls_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 3)
    rows = [(1, "five words in this row", "a", 7)] * 9 + [(None, "five other words are here", "a", 8)] * 5 + [(None, None, None, 9)] * 2 + [(i, "x y " * i, "b", i) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copies int").withColumnRenamed("copies", "part")
    got = mix(docs.repartition(3)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    out = mixing.apply_mix(docs)
    kept = defaultdict(int)
    for r in out.collect():
        kept[tuple(r)] += 1
    assert out.columns == docs.columns and set(kept) <= set(rows)
    for row in set(rows):
        n = len(SPACED.findall(row[1] or ""))
        assert kept[row] == sum(r.copies for r in got if (r.doc_id, r.source, r.size) == (row[0], row[2], n) and n)
    monkeypatch.setattr(mixing, "PLAN_ROWS", 0)  # shuffled instead of broadcast
    assert sorted(map(str, mixing.apply_mix(docs).collect())) == sorted(map(str, out.collect()))


def test_says_when_targets_are_not_met(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 1)
    docs = spark.createDataFrame([(i, "w " * (1 + i), "ab"[i % 2]) for i in range(20)], "doc_id bigint, text string, source string")
    with pytest.raises(RuntimeError):
        mix(docs)


def test_empty(spark):
    assert mix(spark.createDataFrame([], "doc_id bigint, text string, source string")).count() == 0
    assert [r.taken for r in mix(spark.createDataFrame([(1, None, None)], "doc_id bigint, text string, source string")).collect()] == [0]
