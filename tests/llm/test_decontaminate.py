import hashlib
import random

from chainloom.llm.decontaminate import contamination, decontaminate
from tests.llm import brute


def result(found):
    digest = lambda items: hashlib.sha256(",".join(items).encode()).hexdigest()
    return sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"]), digest(r["items"]), r.n_hit > 0) for r in found.collect()), key=str)


def tables():
    rng = random.Random(3)
    word = lambda: rng.choice(["A", "bé", "C-c", "d", "É", "7"]) + str(rng.randrange(3))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([12, 30, 10, 9, 3, 1, 14])]
    items += [(7, None), (8, ""), (9, " - "), (1, items[1][1]), (10, items[0][1].upper())]
    docs = [(i, " ".join(word() for _ in range(rng.randrange(60)))) for i in range(40)]
    docs += [(50, f"x, {items[1][1]} y {items[0][1]}"), (51, None), (52, ""), (53, items[3][1].lower()), (53, items[3][1]), (None, "zz " * 3000 + items[6][1])]
    return docs, items


def test_matches_brute_force(spark):
    docs, items = tables()
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    expected = brute.contamination(docs, items)
    assert result(contamination(d, b)) == expected
    assert result(contamination(d, b, piece_bytes=100)) == expected
    assert any(x[5] for x in expected) and not all(x[5] for x in expected)


def test_removal(spark):
    d = spark.createDataFrame([(1, "One two THREE four", 5), (2, "nothing Here", 6), (3, None, 7)], "doc_id bigint, text string, n_hit int")
    b = spark.createDataFrame([(1, "two three")], "item_id bigint, text string")
    assert sorted(r.doc_id for r in decontaminate(d, b).collect()) == [2, 3]
    cut = {r.doc_id: (r.text, r.n_hit) for r in decontaminate(d, b, how="spans").collect()}
    assert cut == {1: ("one four", 5), 2: ("nothing Here", 6), 3: (None, 7)}
    assert decontaminate(d.limit(0), b).count() == 0
    assert decontaminate(d, b.limit(0)).count() == 3


def test_dropping_documents_takes_one_python_worker_a_task(spark):
    docs, items = tables()
    docs, items = [*docs, (60, f"a {items[2][1]}")], [*items, (None, items[2][1])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    kept = decontaminate(d, b)
    assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    clean = contamination(d, b).where("n_hit = 0").select("doc_id", "text")
    assert 0 < kept.count() < len(docs) and sorted(map(str, kept.collect())) == sorted(map(str, clean.collect()))
