import random
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from chainloom.llm.mixing import apply_mix, mix
from tests.llm import brute


def test_apply_mix_repeats_rows(spark):
    rows = [(i // 2 if i % 5 else None, f"t{i % 7} " * (1 + i % 9), ["a", None, "b"][i % 3], i % 4) for i in range(120)]
    rows += [(7, "same words", "a", 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copies int")
    out = apply_mix(docs)
    assert out.columns == docs.columns
    got = Counter(map(tuple, out.collect()))
    assert set(got) <= set(rows) and all(n <= 3 * rows.count(r) for r, n in got.items())
    assert sum(got.values()) == sum(r.copies for r in mix(docs).collect())
    assert sum(len(r[1].split()) * n for r, n in got.items()) == sum(r.taken for r in mix(docs).collect())


def test_whole_pipeline(spark, tmp_path):
    rng = random.Random(11)
    passage = " ".join(f"q{i}" for i in range(12))
    docs, labels = [], []
    for i in range(160):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(60, 140))]
        bad = i % 4 == 1
        if bad:
            words[::9] = ["vile"] * len(words[::9])
        if i % 10 == 2:
            words[30:30] = passage.split()
        docs.append((i, " ".join(words), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(bad)))
    docs += [(1000 + i, docs[i][1], "en", "s0", 0) for i in range(0, 40, 4)]
    docs += [(2000 + i, docs[i][1].replace("w1", "x1", 1), "en", "s1", 0) for i in range(0, 40, 4)]
    d = f"file://{tmp_path}"
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")

    kept = spark.read.parquet(f"{d}/documents.parquet")
    want = {r[0]: r for r in docs}
    expected = [
        {i for i in want if i % 1000 % 4 != 1},
        {i for i in want if i % 4 != 1 and i < 1000},
        {i for i in want if i % 4 != 1 and i < 1000 and i % 10 != 2},
    ]
    for (_, stage), ids in zip(corpus_pipeline.STAGES[:3], expected):
        kept = stage(spark, kept, d)
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted(r.doc_id for r in kept.collect()) == sorted(ids)
    rows = [r for r in docs if r[0] in expected[2]]
    mixed = apply_mix(spark.createDataFrame(rows, kept.schema)).collect()
    tok, at, ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for r in sorted(mixed, key=lambda r: r.doc_id):
        n = len(tok.encode(r.text, add_special_tokens=False).ids) + 1
        ids.append((r.doc_id, at, n))
        at += n
    got = corpus_pipeline.run(spark, d)
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in got.collect()) == sorted(ids)
    assert brute.contamination([(r.doc_id, r.text) for r in mixed], [(1, passage)])[0][5] is False
