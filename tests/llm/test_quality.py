import random
import tracemalloc

import numpy as np
import pytest

from chainloom.llm import quality, shared


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(20, 120))]
        grade = rng.choice([0, 1, 2, 2, 2])
        if grade < 2:
            words += rng.choices(["vile", "rotten", "foul"], k=4)
        if grade < 1:
            words = [w + "$$$" for w in words]
        rng.shuffle(words)
        rows.append((seed * 10000 + i, " ".join(words), grade))
    return rows


def test_held_out_accuracy(spark):
    made, held = corpus(400, 1), corpus(200, 2)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string, grade int")
    model = quality.train(frame(made).drop("grade"), frame(made))
    assert model.grades == [0, 1, 2] and (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in quality.score(frame(held), model).collect()}
    right = [(got[d].tail >= 0.5) == (g == 2) for d, _, g in held]
    assert sum(right) >= 0.95 * len(right)
    near = [abs(got[d].expected_grade - g) < 0.5 for d, _, g in held]
    assert sum(near) >= 0.9 * len(near)


def test_features_match_a_plain_version():
    texts = [b"One, two!! one", b"", None, "é 12".encode(), b"??"]
    whose, bucket, dense = quality.features(texts)
    assert [int((whose == i).sum()) for i in range(5)] == [4, 0, 0, 2, 1]
    assert np.isclose(dense[0, 2], 3 / 14) and np.isclose(dense[0, 0], 1 / 14) and (dense[1] == 0).all()
    assert len(set(bucket.tolist())) == 7


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (2, "", 6.0), (2, "", 6.0), (None, "a " * 100000, None)], "doc_id bigint, text string, tail double")
    none = spark.createDataFrame([], "doc_id bigint, grade int")
    out = quality.score(docs, quality.train(docs, none))
    assert out.columns == ["doc_id", "text", "tail", "expected_grade", "_tail"] and out.count() == 4
    one = spark.createDataFrame([(1, 3), (1, 3), (None, 2), (2, None)], "doc_id bigint, grade int")
    assert {r.expected_grade for r in quality.score(docs, quality.train(docs, one)).collect()} == {3.0}
    assert quality.score(docs.limit(0), quality.train(docs, one)).count() == 0
    two = spark.createDataFrame([(7, 3), (8, 1)], "doc_id bigint, grade int")
    assert quality.score(docs, quality.train(docs, two)).count() == 4


def test_too_many_grades(spark, monkeypatch):
    monkeypatch.setattr(quality, "GRADES", 2)
    docs = spark.createDataFrame([(i, "a b c", i) for i in range(3)], "doc_id bigint, text string, grade int")
    with pytest.raises(ValueError, match="more than 2 grades"):
        quality.train(docs, docs)


def test_a_batch_of_many_texts_takes_little_memory(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(9999)}" for _ in range(500)).encode() for _ in range(1200)]
    monkeypatch.setattr(shared, "_byte_powers", shared.Powers(shared._B))
    model = quality.Model(np.zeros(quality.BUCKETS, dtype=np.float32), np.zeros(quality.DENSE), np.zeros(1), [0, 1])
    tracemalloc.start()
    assert model.tails(texts).shape == (1200, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 28 << 20  # 14 MB; 57 MB in slices of 1 MB
