"""Operator 10, substring dedup: Rabin-Karp hashes of every fixed-length word window.

Two shuffles carry the work.  Documents go to blocks by a hash of the row.  A block
sends each of its distinct window hashes once (a flag tells that it repeats inside),
packed per hash bucket, so a passage that a third of all documents share costs one
entry per block.  A bucket counts its hashes and sends each block one bit per hash.
The block hashes its windows again, merges the repeated ones into maximal intervals
and removes them.  Block and bucket number with the 64-bit hash make the identity of a
window (the bucket is taken from an independent hash).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.shared import SPACED, Words, as_binary, count_blocks, covered, rolling, sql_name, texts_of, with_blocks

#: Bytes of text in a block, and words (about as many windows) in a hash bucket.
BLOCK_BYTES = 1 << 20
BUCKET_WORDS = 1 << 21


def _hashed(texts: list[bytes | None], window: int, buckets: int):
    """Words; windows' first words; their order by (bucket, hash); distinct ones' first places and counts in it."""
    words = Words(texts, SPACED)
    at = words.windows(window)
    h = words.hashes()
    key = rolling(h, at, window)
    bucket = rolling(h, at, window, lane=1) % np.uint64(buckets)
    order = np.lexsort((key, bucket))
    k, b = key[order], bucket[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (b[1:] != b[:-1])
    heads = np.flatnonzero(new)
    counts = np.diff(np.append(heads, len(k)))
    return words, at, order, k[heads], b[heads].astype(np.int64), counts


def _cuts(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal buckets: their starts and ends."""
    if not len(bucket):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    starts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1])
    return starts, np.append(starts[1:], len(bucket))


def repeated_spans(docs: DataFrame, text: str = "text", window: int = 35) -> DataFrame:
    """The documents with ``n_words``, ``n_removed``, ``kept`` (binary: kept words, one space between) and ``spans``.

    ``spans`` holds the maximal removed intervals as [first word, last word + 1).  All
    other columns stay.  Null texts have no words.  Texts shorter than the window keep
    every word.  Rows that are repeated count as that many documents, so their windows
    repeat.  An empty table gives an empty table.
    """
    blocks = count_blocks(docs, text, BLOCK_BYTES)
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    buckets = max(128, total // (6 * BUCKET_WORDS))
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*names.values())
    body = names[text]
    rows = with_blocks(plain.withColumn("body", as_binary(body)).drop(body), blocks, *[c for c in plain.columns if c != body and dict(plain.dtypes)[c] not in ("variant",)], "body")

    def send(table: pa.Table) -> pa.Table:
        _, _, _, key, bucket, counts = _hashed(texts_of(table["body"]), window, buckets)
        starts, ends = _cuts(bucket)
        block = table["block"][0].as_py()
        return pa.table(
            {
                "bucket": pa.array(bucket[starts], pa.int32()),
                "block": pa.array([block] * len(starts), pa.int32()),
                "keys": pa.array([key[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary()),
                "twice": pa.array([np.packbits(counts[s:e] > 1).tobytes() for s, e in zip(starts, ends)], pa.binary()),
            }
        )

    def count(table: pa.Table) -> pa.Table:
        block = table["block"].to_pylist()
        keys = [np.frombuffer(x, dtype=np.uint64) for x in table["keys"].to_pylist()]
        sizes = np.array([len(x) for x in keys])
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=n) for x, n in zip(table["twice"].to_pylist(), sizes)]).astype(bool)
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        sorted_keys = every[order]
        same = np.zeros(len(every), dtype=bool)
        same[1:] = sorted_keys[1:] == sorted_keys[:-1]
        repeated = same.copy()
        repeated[:-1] |= same[1:]
        flags = twice
        flags[order] |= repeated
        at = np.concatenate([[0], np.cumsum(sizes)])
        found = [i for i in range(len(block)) if flags[at[i] : at[i + 1]].any()]
        return pa.table(
            {
                "block": pa.array([block[i] for i in found], pa.int32()),
                "bucket": pa.array([table["bucket"][0].as_py()] * len(found), pa.int32()),
                "repeated": pa.array([np.packbits(flags[at[i] : at[i + 1]]).tobytes() for i in found], pa.binary()),
            }
        )

    others = [c for c in rows.columns if c not in ("body", "block")]

    def remove(docs_: pa.Table, marks: pa.Table) -> pa.Table:
        texts = texts_of(docs_["body"])
        words, at, order, _, bucket, counts = _hashed(texts, window, buckets)
        starts, ends = _cuts(bucket)
        flags = np.zeros(len(bucket), dtype=bool)
        place = {int(bucket[s]): (s, e) for s, e in zip(starts, ends)}
        for b, bits in zip(marks["bucket"].to_pylist(), marks["repeated"].to_pylist()):
            s, e = place[b]
            flags[s:e] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=e - s)
        hit = np.zeros(len(at), dtype=bool)
        hit[order] = np.repeat(flags, counts)
        gone = covered(len(words), at[hit], window)
        data, place_of = words.compact()
        joined = np.frombuffer(data, dtype=np.uint8)
        byte_kept = np.repeat(~gone, np.diff(place_of))
        kept_all = joined[byte_kept].tobytes()
        kept_before = np.concatenate([[0], np.cumsum(np.where(gone, 0, np.diff(place_of)))])
        gone_before = np.concatenate([[0], np.cumsum(gone)])
        kept, spans, removed = [], [], []
        for i in range(len(texts)):
            a, b = words.first[i], words.first[i + 1]
            kept.append(kept_all[kept_before[a] : kept_before[b]][:-1])
            removed.append(int(gone_before[b] - gone_before[a]))
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].astype(np.int8), [0]]))) if removed[-1] else ()
            spans.append([[int(x), int(y)] for x, y in zip(edge[0::2], edge[1::2])])
        out = docs_.select(others)
        for name, column in (("body", docs_["body"]), ("n_words", pa.array(words.counts(), pa.int64())), ("n_removed", pa.array(removed, pa.int64())), ("kept", pa.array(kept, pa.binary())), ("spans", pa.array(spans, pa.list_(pa.list_(pa.int64()))))):
            out = out.append_column(name, column)
        return out

    sent = rows.groupBy("block").applyInArrow(send, "bucket int, block int, keys binary, twice binary")
    marks = sent.groupBy("bucket").applyInArrow(count, "block int, bucket int, repeated binary")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in others), "body binary", "n_words bigint", "n_removed bigint", "kept binary", "spans array<array<bigint>>"])
    done = rows.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(remove, schema)
    new = {c: sql_name(docs, c) for c in ("n_words", "n_removed", "kept", "spans")}
    return done.select(*[(F.col("body").cast("string") if c == text else F.col(n)).alias(c) for c, n in names.items()], *[F.col(c).alias(n) for c, n in new.items()])


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = repeated_spans(docs)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
