import random

import numpy as np

from chainloom.llm import simhash
from tests.llm import brute


def test_anchors_cover_and_meet():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 32, 500, dtype=np.uint64).astype(np.uint32)
    home = simhash.homes(x)
    assert (np.bitwise_count(home ^ x) <= 1).all() and (simhash.homes(home) == home).all()
    for flips in [[]] + [[k] for k in range(32)]:
        y = x.copy()
        for k in flips:
            y ^= np.uint32(1 << k)
        who, near = simhash.replicas(y)
        assert (np.bitwise_count(near ^ y[who]) <= 2).all()
        at = set(zip(who.tolist(), near.tolist()))
        assert all((i, h) in at for i, h in enumerate(home.tolist()))


def corpus():
    rng = random.Random(2)
    word = lambda: rng.choice("The of And reä thing bo".split()) + rng.choice(["", "s", "Ing", "é"])
    rows = []
    for i in range(30):
        base = [word() for _ in range(rng.randrange(1, 150))]
        rows.append((i * 10, " ".join(base)))
        for k in range(rng.randrange(5)):
            copy = list(base)
            for _ in range(k):
                copy[rng.randrange(len(copy))] = word()
            rows.append((i * 10 + k + 1, "\n".join(copy)))
    return rows + [(900, None), (901, ""), (902, " \t"), (903, "One"), (904, "one two"), (905, rows[3][1].upper()), (905, rows[3][1].upper()), (906, "x" * 100000)]


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, bytes(r.fp).hex(), r.component_id) for r in simhash.near_duplicates(docs, size=3, bits=64, distance=3, within=1, arrangements=1, distinct=False).collect())
    fps = [(d, brute.simhash(t)) for d, t in rows]
    links = [(a, b) for a, x in fps for b, y in fps if a < b and (x ^ y).bit_count() <= 3]
    up = brute.components({d for d, _ in fps}, links)
    assert got == sorted((d, f"{x:016x}", up[d]) for d, x in fps)
    assert len({c for *_, c in got}) < len(rows)


def test_tiles_and_wide_fingerprints(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{rng.randrange(900)}" for _ in range(400)]
    rows = []
    for i in range(60):
        copy = list(base)
        copy[i * 5] = "changed"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, " ".join(f"v{rng.randrange(900)}" for _ in range(300))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(simhash, "TILE", 7)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got == {d: 0 if d < 100 else d for d, _ in rows}
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [0, *range(100, 120)]


def test_bit_counts():
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    begin = np.array([0, 1, 256, 511, 2000])
    want = [[sum(int(h) >> k & 1 for h in part) for k in range(64)] for part in np.split(hashes, begin[1:])]
    assert simhash.bit_counts(hashes, begin).tolist() == want


def test_finds_copies_at_the_threshold(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(5000)}"
    rows, similar = [], []
    for i in range(60):
        base = [word() for _ in range(300)]
        copy = list(base)
        for k in range(1 + i % 6):
            copy[20 + 40 * k] = word()
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
        shingles = [{tuple(t[k : k + 5]) for k in range(296)} for t in (base, copy)]
        similar.append(len(shingles[0] & shingles[1]) / len(shingles[0] | shingles[1]))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[d] in (d, d - d % 2) for d, _ in rows)
    sure = [i for i, s in enumerate(similar) if s > 0.85]
    assert len(sure) >= 40 and all(got[2 * i + 1] == 2 * i for i in sure)
    assert sum(got[2 * i + 1] == 2 * i for i in range(60)) >= 55


def test_groups_meet_at_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 4)
    rng = random.Random(7)
    base = rng.getrandbits(64)
    prints = {base}
    for _ in range(40):  # chains of small steps from one another, so no pivot sees all of them
        prints.add(rng.choice(sorted(prints)) ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    prints = sorted(prints)
    classes = spark.createDataFrame([(i, bytearray(p.to_bytes(8, "big"))) for i, p in enumerate(prints)], "cls bigint, fp binary")
    links = [(r.a, r.b) for r in simhash._links(classes, 1, 3, 1, 1).collect()]
    want = [(i, j) for i, p in enumerate(prints) for j, q in enumerate(prints) if i < j and (p ^ q).bit_count() <= 3]
    assert brute.components(set(range(len(prints))), links) == brute.components(set(range(len(prints))), want)


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (None, "q r s t"), (4, None)], "doc_id bigint, text string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(None, 3), (3, 3), (None, None), (4, 4)}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.keep_one(docs.withColumn("gone", docs.doc_id).withColumn("sig", docs.doc_id))
    assert kept.columns == ["doc_id", "text", "gone", "sig"]
    assert sorted((r.doc_id is None, r.text or "") for r in kept.collect()) == [(False, ""), (False, "a b c"), (True, "q r s t")]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_keep_one_of_repeated_rows_and_ids(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(5, long)] * 4 + [(5, "quite another text of its own"), (6, long), (None, long), (None, "alone by itself is this")] + [(None, "twice and nobody's")] * 2
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"))
    want = [(5, long), (5, "quite another text of its own"), (None, "alone by itself is this"), (None, "twice and nobody's")]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)


def planted(n):
    """Pairs of documents with some words replaced, and the similarity of each pair's five-word shingles."""
    rng, rows, similar = random.Random(8), [], []
    word = lambda: f"w{rng.randrange(5000)}"
    for i in range(n):
        base = [word() for _ in range(rng.randrange(150, 500))]
        copy = list(base)
        for k in rng.sample(range(len(base)), max(1, int(len(base) * rng.choice([0.004, 0.01, 0.015, 0.02, 0.022, 0.05])))):
            copy[k] = word()
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
        similar.append(jaccard(base, copy))
    return rows, similar


def jaccard(a, b):
    x, y = ({tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_recall_by_band_of_similarity(spark):
    rows, similar = planted(800)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    assert all(got[d] in (d, d - d % 2) for d, _ in rows)
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.0)):
        band = [i for i, s in enumerate(similar) if low <= s < high]
        found = sum(got[2 * i + 1] == 2 * i for i in band)
        assert len(band) >= 40 and found >= 0.9 * len(band), (low, high, found, len(band))
    far = [i for i, s in enumerate(similar) if s < 0.72]
    assert far and not any(got[2 * i + 1] == 2 * i for i in far)


def test_recall_on_the_documents(spark):
    """All pairs of 0.8 or more of a whole test table, found by brute force over shared shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    words = {r.doc_id: brute.SPACED.findall(brute.lower(r.text)) for r in docs.collect()}
    holders = {}
    for d, w in words.items():
        for k in range(max(1, len(w) - 4)):
            holders.setdefault(tuple(w[k : k + 5]), set()).add(d)
    pairs = {(a, b) for have in holders.values() if len(have) > 1 for a in have for b in have if a < b}
    similar = [(a, b) for a, b in pairs if jaccard(words[a], words[b]) >= 0.8]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert len(similar) >= 5 and sum(got[a] == got[b] for a, b in similar) >= 0.9 * len(similar)
