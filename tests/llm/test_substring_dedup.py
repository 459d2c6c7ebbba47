import hashlib
import random

from chainloom.llm.substring_dedup import repeated_spans
from tests.llm import brute


def result(spark, rows, **k):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    done = repeated_spans(docs, **k)
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in done.collect()), key=str)


def corpus():
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "bé", "cc", "d　d", "ee", "f"]) + str(rng.randrange(40))
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join(word() for _ in range(rng.randrange(120)))) for i in range(40)]
    rows += [(40 + i, " \t".join([word() for _ in range(i)] + passage + [word() for _ in range(9)]) + "\n") for i in range(8)]
    rows += [(60, " ".join(passage[:35])), (61, " ".join(passage[:34])), (62, None), (63, ""), (64, " \n "), (65, "x " * 200)]
    rows += [(66, rows[3][1]), (66, rows[3][1]), (None, rows[5][1]), (67, "y" * 5000)]
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    assert result(spark, rows) == brute.substring(rows)
    assert result(spark, rows, window=5) == brute.substring(rows, 5)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert repeated_spans(empty).count() == 0
    odd = spark.createDataFrame([(1, "a b c", 7, "x", "body"), (2, "a b d", 8, None, None)], "doc_id bigint, text string, n_words int, block string, body string")
    out = repeated_spans(odd, window=2).orderBy("doc_id")
    assert out.columns == ["doc_id", "text", "n_words", "block", "body", "_n_words", "n_removed", "kept", "spans"]
    assert [(r.text, r.n_words, r._n_words, bytes(r.kept), r.spans) for r in out.collect()] == [("a b c", 7, 3, b"c", [[0, 2]]), ("a b d", 8, 3, b"d", [[0, 2]])]
