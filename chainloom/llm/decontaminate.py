"""Operator 8, benchmark decontamination: a broadcast hash set of the benchmark's word n-grams.

The set is broadcast in pieces of a checked size.  A benchmark within one piece (the
usual case) takes one narrow scan of the documents, with no shuffle.  A larger one takes a
pass of the documents for each piece, so that a task holds one piece at a time and builds
its set once; what the passes before have found goes along in the shared folder.  Hits are
verified against the words themselves.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from chainloom.llm.shared import ALNUM, Scratch, Words, as_binary, covered, rolling, slices, sql_name, texts_of

#: Bytes of benchmark text in one broadcast piece.
PIECE_BYTES = 16 << 20


class Grams:
    """The n-grams of some items: sorted hashes by length, their words, and the items that have them."""

    def __init__(self, items: list[tuple[object, bytes | None]], window: int):
        grams: dict[int, dict[bytes, set]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            words = Words([text], ALNUM, lower=True)
            size = min(window, len(words))
            if size:
                data, at = words.compact()
                for i in range(len(words) - size + 1):
                    grams[size][data[at[i] : at[i + size] - 1]].add(item)
        self.sizes = {}
        for size, texts in grams.items():
            keys, found = [], []
            for text, ids in texts.items():
                w = Words([text], ALNUM)
                keys.append(int(rolling(w.hashes(), np.zeros(1, dtype=np.int64), size)[0]))
                found.append((text, frozenset(ids)))
            by_key: dict[int, list] = defaultdict(list)
            for k, x in zip(keys, found):
                by_key[k].append(x)
            self.sizes[size] = (np.array(sorted(by_key), dtype=np.uint64), dict(by_key))

    def hits(self, words: Words):
        """(first word, size, items) of every verified occurrence."""
        if not len(words):
            return
        h, text = words.hashes(), None
        for size, (keys, by_key) in self.sizes.items():
            at = words.windows(size)
            if not len(at):
                continue
            key = rolling(h, at, size)
            near = np.searchsorted(keys, key)
            near[near == len(keys)] = 0
            for i in np.flatnonzero(keys[near] == key):
                if text is None:
                    text, place = words.compact()
                w = int(at[i])
                said = text[place[w] : place[w + size] - 1]
                for gram, items in by_key[int(key[i])]:
                    if gram == said:
                        yield w, size, items


_FOUND = "struct<n_words bigint, items array<string>, marks array<array<bigint>>>"


def _scan(items: list, window: int):
    """Column function of a text: its number of words, and the items and (first word, size) of its hits on a piece."""
    held: list[Grams] = []  # of this worker, built at its first batch

    @F.arrow_udf(_FOUND)
    def scan(column: pa.Array) -> pa.Array:
        if not held:
            held.append(Grams(items.value, window))
        texts = texts_of(column)
        counts: list[int] = []
        names: list[set] = [set() for _ in texts]
        marks: list[list] = [[] for _ in texts]
        for a, b in slices(texts):
            words = Words(texts[a:b], ALNUM, lower=True)
            counts += words.counts().tolist()
            for w, size, found in held[0].hits(words):
                d = int(np.searchsorted(words.first, w, side="right")) - 1
                marks[a + d].append([w - int(words.first[d]), size])
                names[a + d] |= found
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array([sorted(map(str, s)) for s in names], pa.list_(pa.string())), pa.array(marks, pa.list_(pa.list_(pa.int64())))], ["n_words", "items", "marks"]
        )

    return scan


@F.arrow_udf(returnType=ArrayType(ArrayType(LongType())))
def _spans(counts: pa.Array, marks: pa.Array) -> pa.Array:
    """Maximal runs of hit words, as [first word, last word + 1)."""
    out = []
    for n, m in zip(counts.to_pylist(), marks.to_pylist()):
        at = np.array(m, dtype=np.int64).reshape(-1, 2)
        hit = covered(n, at[:, 0], at[:, 1]) if m else np.zeros(0, dtype=bool)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
        out.append([[int(x), int(y)] for x, y in zip(edge[0::2], edge[1::2])])
    return pa.array(out, pa.list_(pa.list_(pa.int64())))


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The documents with ``n_words``, ``n_hit``, ``items`` (sorted as strings) and ``spans`` of hit words.

    A null text has no words, nor does a null item; an item of fewer words than the
    window is one window itself.  Repeated items count once.  An empty benchmark hits
    nothing; an empty table gives an empty table.  All other columns stay.
    """
    spark = docs.sparkSession
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    body = plain.columns[docs.columns.index(text)]
    wanted = benchmark.select(F.col(item).alias("item"), as_binary(item_text).alias("body")).where("body is not null").distinct()
    total = wanted.agg(F.sum(F.octet_length("body")).alias("n")).first()["n"] or 0
    pieces = -(-int(total) // piece_bytes) or 1
    dealt = wanted.withColumn("piece", F.pmod(F.xxhash64("item", "body"), F.lit(pieces)))
    scratch, before = Scratch(spark, "contamination"), None
    for k in range(pieces):
        # about piece_bytes of items; the driver holds one piece at a time
        items = spark.sparkContext.broadcast([(r.item, bytes(r.body)) for r in dealt.where(F.col("piece") == k).collect()])
        found = plain.withColumn("now", _scan(items, window)(as_binary(body)))
        if before is not None:
            both = lambda c: F.concat(f"found.{c}", f"now.{c}").alias(c)
            found = found.select("*", F.struct("now.n_words", both("items"), both("marks")).alias("all")).drop("found", "now")
        plain = found.withColumnRenamed("now" if before is None else "all", "found")
        if k < pieces - 1:
            last, plain = before, scratch.write(plain)
            if last is not None:
                scratch.remove(last)
            before = plain
    done = plain.withColumn("spans", _spans("found.n_words", "found.marks"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0])
    new = {"n_words": F.col("found.n_words"), "n_hit": n_hit, "items": F.array_sort(F.array_distinct("found.items")), "spans": F.col("spans")}
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)], *[v.alias(sql_name(docs, c)) for c, v in new.items()])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", how: str = "documents", **options) -> DataFrame:
    """The documents without contamination: hit documents go (``documents``) or only their hit words (``spans``).

    With ``spans`` the words that stay of a hit document are joined by single spaces in
    lower case; clean documents keep their text as it was.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    body = plain.columns[docs.columns.index(text)]
    found = contamination(plain, benchmark, text=body, **options)
    if how == "documents":
        # a hit names its item; its spans aren't needed, nor a second Python worker of each task for them
        return found.where("size(items) = 0").select(*plain.columns).toDF(*docs.columns)

    @F.arrow_udf("binary")
    def cut(column: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(column.to_pylist(), spans.to_pylist()):
            if not s:
                out.append(t)
                continue
            data, at = Words([t], ALNUM, lower=True).compact()
            edges = [0, *[x for pair in s for x in pair], len(at) - 1]
            out.append(b"".join(data[at[a] : at[b]] for a, b in zip(edges[0::2], edges[1::2])).rstrip(b" "))
        return pa.array(out, pa.binary())

    return found.withColumn(body, cut(as_binary(body), "spans").cast("string")).select(*plain.columns).toDF(*docs.columns)


def op8_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
