"""The registered queries over a whole test table, against plain versions."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chainloom.llm import quality
from chainloom.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.test_embedding_dedup import expected

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def result(spark, name, *columns):
    df = QUERIES[name](spark, SF)
    assert set(columns) <= set(df.columns)
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_op1(spark, docs):
    tok, at, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for d, t in sorted(docs):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert result(spark, "op1_token_output", "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=str)


def test_op3(spark, docs):
    words = {d: brute.SPACED.findall(t or "") for d, t in docs}
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    own = {d: [grams(w, n) for n in (1, 2, 3)] for d, w in words.items()}
    every = [sum((own[d][k] for d in words), Counter()) for k in range(3)]
    total = sum(map(len, words.values()))
    got = {r[0]: r[1:] for r in result(spark, "op3_lm_score", "doc_id", "n_words", "log_score")}
    for d, w in words.items():
        left = lambda g, d=d: every[len(g) - 1][g] - own[d][len(g) - 1][g]

        def score(context, word, w=w, left=left):
            if not context:
                f, n = left((word,)), total - len(w)
                return f / n if f else 1 / (n + 1)
            f = left((*context, word))
            return f / left(context) if f else 0.4 * score(context[1:], word)

        want = sum(math.log(score(tuple(w[max(0, i - 2) : i]), x)) for i, x in enumerate(w))
        assert got[d][0] == len(w) and abs(got[d][1] - want) < 1e-4 * max(1, abs(want))


def test_op4(spark, docs):
    prints = [(d, brute.simhash(t)) for d, t in docs]
    links = [(a, b) for a, x in prints for b, y in prints if a < b and (x ^ y).bit_count() <= 3]
    up = brute.components({d for d, _ in prints}, links)
    assert result(spark, "op4_simhash", "doc_id", "fingerprint", "component_id") == sorted(((d, f"{x:016x}", up[d]) for d, x in prints), key=str)


def test_op5(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert result(spark, "op5_embedding_dedup", "vec_id", "n_links", "component_id", "kept") == sorted(expected(rows), key=str)


def test_op7(spark, docs):
    """Scores are what plain sums of the fitted weights give; thresholds are in order; good ratings score higher."""
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(table, quality.ratings_of(labels))
    assert list(model.thresholds) == sorted(model.thresholds)
    got = {r[0]: r[1:] for r in result(spark, "op7_quality", "doc_id", "expected_grade", "tail", "keep")}
    assert len(got) == len(docs)
    for d, t in docs:
        whose, bucket, dense = quality.features([None if t is None else t.encode()])
        score = sum(float(model.weights[b]) for b in bucket) + float(dense[0] @ model.dense)
        tails = [1 / (1 + math.exp(c - score)) for c in model.thresholds]
        grade = model.grades[0] + sum(p * (b - a) for p, a, b in zip(tails, model.grades, model.grades[1:]))
        assert abs(got[d][0] - grade) < 1e-4 and abs(got[d][1] - tails[-1]) < 1e-4 and got[d][2] == (tails[-1] >= 0.5 - 1e-9)
    rated = {r.doc_id: r.quality + 1 - r.toxic for r in labels.collect()}
    best = max(rated.values())
    of = lambda side: np.mean([got[d][1] for d, g in rated.items() if (g == best) == side and d in got])
    assert of(True) > 0.5 > of(False)


def test_op8(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = result(spark, "op8_benchmark_decontamination", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(brute.contamination(docs, items), key=str)


def test_op10(spark, docs):
    assert result(spark, "op10_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256") == brute.substring(docs)
