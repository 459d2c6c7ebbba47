import random
import string

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chainloom.llm import token_output as t

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(6)
    bits = ["the", "Héllo", "it's", " ", "  ", "\n", "\t", "12", "??", "a　b", "\xa0", "thstinnt", "…", "'ll", "<|endoftext|>", "😀", "\x1c"]
    made = ["".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(40))) for _ in range(150)]
    return [*made, None, "", " ", "x", " lead", "trail ", "two  spaces", "a \nb", "z" * 20000, "one two three", "one two three"]


def test_coding_round_trip():
    x = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 7], dtype=np.uint32)
    for n in range(9):
        assert (t.unpack(*t.pack(x[:n]), n) == x[:n]).all()


def test_files_hold_what_the_library_says(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(t, "BLOCK_TOKENS", 500)
    rows = [(500 - 3 * i, x) for i, x in enumerate(texts())] + [(None, "null id"), (-5, "neg")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    t.write_tokens(docs, f"file://{tmp_path}/out", PATH)
    got = sorted(t.read_tokens(spark, f"file://{tmp_path}/out").collect(), key=lambda r: r.start)
    tok, at = Tokenizer.from_file(PATH), 0
    for r, (doc, text) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens) == (doc, at, len(ids))
        assert np.frombuffer(bytes(r.ids), dtype="<u4").tolist() == ids
        at += len(ids)


def test_every_sign_is_encoded_as_the_library_does():
    enc = t.encoder(PATH, "<u2")
    signs = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    enc.judge(set(signs))
    assert enc.judged >= set(signs) and {"\x1c", "\x85", "é", "中", "\u088f"} - {"é", "中"} >= enc.odd & {"\x1c", "\x85", "é", "中", "\u088f"}
    for begin in range(0, len(signs), 1 << 14):
        some = [f"a {c}'s" for c in signs[begin : begin + (1 << 14)]]
        assert enc.encode(some) == enc.whole(some)
    rng = random.Random(12)
    odd = sorted(enc.odd) or ["\u088f"]
    mixed = ["".join(rng.choice(["a", "1", "!", " ", "'s", "é", "\n", rng.choice(signs), rng.choice(odd)]) for _ in range(12)) for _ in range(20000)]
    assert enc.encode(mixed) == enc.whole(mixed)


def test_hot_ids_fill_several_parts_and_files_follow_ids(spark, tmp_path):
    rows = [(7, f"hot row {i} " * 20) for i in range(600)] + [(None, f"no id {i} " * 20) for i in range(400)] + [(i, f"own id {i} " * 20) for i in range(-100, 100)]
    path = f"file://{tmp_path}/hot"
    t.write_tokens(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), path, PATH, part_bytes=2000)
    blocks = spark.read.parquet(f"{path}/blocks")
    by_part = {}
    for r in blocks.orderBy("part", "block").collect():
        by_part.setdefault(r.part, []).extend(r.doc_ids)
    ids = [i for p in sorted(by_part) for i in by_part[p]]
    assert ids == sorted([d for d, _ in rows], key=lambda d: (d is not None, d or 0))
    assert max(map(len, by_part.values())) < 200 and sum(7 in p for p in by_part.values()) > 5
    names = {r.file: r.part for r in blocks.select(F.input_file_name().alias("file"), "part").distinct().collect()}
    assert [names[f] for f in sorted(names)] == sorted(names.values())
    got = t.read_tokens(spark, path).select("doc_id", "start", "n_tokens").orderBy("start").collect()
    assert len(got) == len(rows) and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string, ids string")
    t.write_tokens(docs, f"file://{tmp_path}/none", PATH)
    assert t.read_tokens(spark, f"file://{tmp_path}/none").count() == 0


def test_texts_are_packed_together_and_letters_with_signs_after_them_are_not_split():
    rng = np.random.default_rng(3)
    counts = np.array([0, 1, 3, 4, 5, 0, 9, 700, 2])
    ranks = rng.integers(0, 1 << rng.integers(1, 32, counts.sum()), dtype=np.uint32)
    parts = np.split(ranks, np.cumsum(counts)[:-1])
    control, data = t.pack_each(ranks, counts)
    assert list(zip(control, data)) == [t.pack(x) for x in parts]
    assert (t.unpack(b"".join(control), b"".join(data), counts) == ranks).all()

    enc = t.Encoder(PATH, "<u2")
    enc.judge(set("Étéoïve"))
    enc.split = None  # no pattern is needed for these
    made = ["x " + " ".join(f"{w}{s}" for w in ("dog", "Étéo", "naïve", "zzyzx") for s in (*string.punctuation, "...", "?!", "'\"", "'", "!'"))]
    assert enc.encode(made) == enc.whole(made) and enc.encode(made) == enc.whole(made)


def test_an_encoder_forgets_words_seen_once():
    enc = t.Encoder(PATH, "<u2")
    for begin in range(0, 700_000, 20_000):
        texts = [" " + " ".join(f"w{i}" for i in range(begin, begin + 20_000))]
        assert len(enc.encode(texts)) == 1
        assert len(enc.words) + len(enc.older) < 450_000
    assert enc.encode(["x w1 w699999 w1"]) == enc.whole(["x w1 w699999 w1"])
