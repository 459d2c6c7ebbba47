"""Operator 3, LM scoring: stupid-backoff scores from n-gram counts of the whole corpus.

Relationally: explode documents into n-grams, count n-grams in tables partitioned by hash,
join the counts back to the exploded n-grams, sum scores by document.  N-grams travel
packed: a block of documents sends each of its distinct n-grams once to its hash bucket,
with its count in the block (so hot n-grams and copies are summed before the shuffle);
the bucket sums the counts and joins the sums to the n-grams that each block sent.

A document is scored by the counts of all other documents: its own are taken off, so no
text vouches for itself, and copies of it do.  With ``f`` such counts, ``a`` the context
without its first word and ``N`` the words of other documents:

    S(w | context) = f(context w) / f(context)   if f(context w) > 0
                   = backoff * S(w | a)          otherwise
    S(w)           = f(w) / N                    if f(w) > 0, else 1 / (N + 1)

A bucket's n-grams are told apart by 48 bits of hash; buckets grow in number with the
corpus, so about one n-gram in 10**8 is taken for another, at any size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from chainloom.llm.shared import SPACED, Words, as_binary, rolling, sql_name, with_blocks, word_count
from chainloom.llm.token_output import pack, unpack

#: Bytes of text in a block, and n-grams (about) in a bucket.
BLOCK_BYTES = 2 << 20
BUCKET_GRAMS = 1 << 21
_KEY = np.uint64((1 << 48) - 1)


def pack_counts(n: np.ndarray) -> tuple[bytes, bytes]:
    """A bit each for more than 1, then those in one to four bytes with two bits of control; high halves of 64 bits apart, if any."""
    more = n[n > 1]
    control, data = pack(more & 0xFFFFFFFF)
    high = more >> 32
    return np.packbits(n > 1).tobytes() + control + data, high.astype("<i4").tobytes() if high.any() else b""


def unpack_counts(small: bytes, large: bytes, size: int) -> np.ndarray:
    bits = -(-size // 8)
    is_more = np.unpackbits(np.frombuffer(small, dtype=np.uint8, count=bits), count=size).astype(bool)
    n = np.ones(size, dtype=np.int64)
    k = int(is_more.sum())
    at = bits + -(-k // 4)
    more = unpack(small[bits:at], small[at:], k).astype(np.int64)
    if large:
        more |= np.frombuffer(large, dtype="<i4").astype(np.int64) << 32
    n[is_more] = more
    return n


_GAP = (1 << 40) - 1


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as gaps of five bytes; larger gaps stand apart, in turn, before them (a number tells how many)."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    wide = gaps[gaps >= _GAP]
    five = np.minimum(gaps, np.uint64(_GAP)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    return len(wide).to_bytes(4, "little") + wide.astype("<u8").tobytes() + five.tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    five = np.frombuffer(data, dtype=np.uint8, offset=4 + 8 * n).reshape(-1, 5)
    gaps = np.zeros((len(five), 8), dtype=np.uint8)
    gaps[:, :5] = five
    gaps = gaps.view("<u8").reshape(-1)
    gaps[gaps == _GAP] = np.frombuffer(data, dtype="<u8", count=n, offset=4)
    return np.cumsum(gaps, dtype=np.uint64)


@F.arrow_udf(returnType=BinaryType())
def squeezed(column: pa.Array) -> pa.Array:
    """Zstandard frames of the texts, for their shuffle."""
    z = zstandard.ZstdCompressor(level=3)
    return pa.array([None if t is None else z.compress(t) for t in column.to_pylist()], pa.binary())


def _texts(column) -> list[bytes | None]:
    z = zstandard.ZstdDecompressor()
    return [None if t is None else z.decompress(t) for t in column.to_pylist()]


class Level:
    """Some windows of words: their distinct n-grams in order of (bucket, key), with counts."""

    def __init__(self, hashes: np.ndarray, windows: dict[int, np.ndarray], buckets: int):
        keys, where = [], []
        for n, at in windows.items():
            keys.append(rolling(hashes + np.uint64(n), at, n) & _KEY)
            where.append(rolling(hashes + np.uint64(n), at, n, lane=1) % np.uint64(buckets))
        key, bucket = np.concatenate(keys), np.concatenate(where)
        if buckets <= 1 << 16:
            sort = np.argsort(bucket << np.uint64(48) | key, kind="stable")
        else:
            sort = np.lexsort((key, bucket))
        k, b = key[sort], bucket[sort]
        new = np.ones(len(k), dtype=bool)
        new[1:] = (k[1:] != k[:-1]) | (b[1:] != b[:-1])
        heads = np.flatnonzero(new)
        self.windows = windows
        self.keys, self.buckets = k[heads], b[heads].astype(np.int64)
        self.counts = np.diff(np.append(heads, len(k)))
        which = np.empty(len(k), dtype=np.int64)
        which[sort] = np.cumsum(new) - 1
        #: for each n, the distinct n-gram at each window
        self.which = dict(zip(windows, np.split(which, np.cumsum([len(a) for a in windows.values()])[:-1])))
        edges = np.flatnonzero(np.diff(self.buckets, prepend=-1)).tolist()
        self.cuts = {int(self.buckets[s]): (s, e) for s, e in zip(edges, [*edges[1:], len(self.buckets)])}

    def rows(self, block: int) -> pa.Table:
        """Its n-grams by bucket."""
        packed = [pack_counts(self.counts[s:e]) for s, e in self.cuts.values()]
        return pa.table(
            {
                "bucket": pa.array([*self.cuts], pa.int32()),
                "block": pa.array([block] * len(packed), pa.int32()),
                "keys": pa.array([pack_keys(self.keys[s:e]) for s, e in self.cuts.values()], pa.binary()),
                "small": pa.array([x[0] for x in packed], pa.binary()),
                "large": pa.array([x[1] for x in packed], pa.binary()),
            }
        )

    def totals(self, sums: list[dict]) -> np.ndarray:
        total = np.zeros(len(self.keys), dtype=np.int64)
        for r in sums:
            s, e = self.cuts[r["bucket"]]
            total[s:e] = self.counts[s:e] + unpack_counts(r["small"], r["large"], e - s) - 1
        return total


class Block:
    """A block's words, and how often each window's n-gram occurs outside its own document."""

    def __init__(self, texts: list[bytes | None], buckets: int):
        self.words, self.buckets = Words(texts, SPACED), buckets
        self.hashes = self.words.hashes()
        self.left: dict[int, np.ndarray] = {}

    def level(self, n: int) -> Level:
        """Level 2 has all words and pairs; level n > 2 the n-grams of which both parts of n - 1 words occur elsewhere."""
        if n == 2:
            return Level(self.hashes, {1: self.words.windows(1), 2: self.words.windows(2)}, self.buckets)
        at = self.words.windows(n)
        there = self.left[n - 1] > 0
        return Level(self.hashes, {n: at[there[at] & there[at + 1]]}, self.buckets)

    def hear(self, level: Level, sums: list[dict]) -> None:
        totals = level.totals(sums)
        for n, at in level.windows.items():
            whose = np.searchsorted(self.words.first, at, side="right") - 1
            _, back, counts = np.unique(whose * max(len(level.keys), 1) + level.which[n], return_inverse=True, return_counts=True)
            f = np.zeros(len(self.words), dtype=np.int64)
            if len(at):
                f[at] = totals[level.which[n]] - counts[back]
            self.left[n] = f

    def scores(self, corpus_words: int, order: int, backoff: float) -> np.ndarray:
        """Sum of log scores of each text."""
        words, n_words = self.words, self.words.counts()
        whose = np.repeat(np.arange(len(n_words)), n_words)
        others = (corpus_words - n_words)[whose]
        one = self.left[1]
        p = np.where(one > 0, one / np.maximum(others, 1), 1.0 / (others + 1))
        place = np.arange(len(words)) - words.first[:-1][whose]
        for n in range(2, order + 1):
            # the window that ends at each word, its context (n - 1 words), and the word's score by less context
            at = np.maximum(np.arange(len(words)) - n + 1, 0)
            there = place >= n - 1
            f = np.where(there, self.left[n][at], 0)
            p = np.where(there, np.where(f > 0, f / np.maximum(self.left[n - 1][at], 1), backoff * p), p)
        return np.bincount(whose, np.log(p), minlength=len(n_words)).astype(np.float64)


def _add(table: pa.Table, level: int) -> pa.Table:
    """Sums of the counts that blocks sent to a bucket, for each of them."""
    bucket, block = table["bucket"][0].as_py(), table["block"].to_pylist()
    keys = [unpack_keys(x) for x in table["keys"].to_pylist()]
    n = np.concatenate([unpack_counts(a, b, len(k)) for a, b, k in zip(table["small"].to_pylist(), table["large"].to_pylist(), keys)])
    at = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    _, back = np.unique(np.concatenate(keys), return_inverse=True)
    # 1 and what other blocks have: mostly just that
    total = np.bincount(back, n).astype(np.int64)[back] - n + 1  # exact below 2**53
    packed = [pack_counts(total[a:b]) for a, b in zip(at[:-1], at[1:])]
    return pa.table(
        {
            "block": pa.array(block, pa.int32()),
            "level": pa.array([level] * len(block), pa.int32()),
            "bucket": pa.array([bucket] * len(block), pa.int32()),
            "small": pa.array([x[0] for x in packed], pa.binary()),
            "large": pa.array([x[1] for x in packed], pa.binary()),
        }
    )


_SENT = "bucket int, block int, keys binary, small binary, large binary"
_SUMS = "block int, level int, bucket int, small binary, large binary"


def score(docs: DataFrame, text: str = "text", order: int = 3, backoff: float = 0.4) -> DataFrame:
    """The documents, without the text, with ``n_words``, ``log_score`` (sum of natural logs) and ``mean_log_score``.

    Null texts and texts of no words have 0 words, log score 0 and a null mean.  The first
    words of a text use what context there is.  Repeated rows count as that many documents.
    An empty table gives an empty table.

    Words and pairs are counted in one round, each longer n in a round of its own, which
    leaves out n-grams that can't occur elsewhere since a part of them doesn't.
    """
    facts = docs.agg(F.sum(F.octet_length(text)).alias("bytes"), F.sum(word_count(text)).alias("words")).first()
    blocks, corpus = max(16, -(-int(facts["bytes"] or 0) // BLOCK_BYTES)), facts["words"] or 0
    buckets = max(128, blocks * BLOCK_BYTES * 2 // (6 * BUCKET_GRAMS))
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    body = plain.columns[docs.columns.index(text)]
    rows = plain.withColumn("body", as_binary(body)).drop(body)
    rows = with_blocks(rows, blocks, *rows.columns).withColumn("body", squeezed("body"))
    carried = [c for c in rows.columns if c not in ("body", "block")]

    def heard(docs_: pa.Table, sums: pa.Table, last: int) -> Block:
        block, by_level = Block(_texts(docs_["body"]), buckets), {}
        for r in sums.to_pylist():
            by_level.setdefault(r["level"], []).append(r)
        for n in range(2, last + 1):
            block.hear(block.level(n), by_level.get(n, []))
        return block

    def send_first(table: pa.Table) -> pa.Table:
        block = Block(_texts(table["body"]), buckets)
        return block.level(2).rows(table["block"][0].as_py())

    def sender(n: int):
        def send(docs_: pa.Table, sums: pa.Table) -> pa.Table:
            return heard(docs_, sums, n - 1).level(n).rows(docs_["block"][0].as_py())

        return send

    def fuse(docs_: pa.Table, sums: pa.Table) -> pa.Table:
        block = heard(docs_, sums, max(order, 2))
        n, logs = block.words.counts(), block.scores(corpus, order, backoff)
        out = docs_.select(carried)
        for name, column in (("n_words", pa.array(n, pa.int64())), ("log_score", pa.array(logs)), ("mean_log_score", pa.array(logs / np.maximum(n, 1), mask=n == 0))):
            out = out.append_column(name, column)
        return out

    def added(sent: DataFrame, n: int) -> DataFrame:
        return sent.groupBy("bucket").applyInArrow(lambda t: _add(t, n), _SUMS)

    sums = added(rows.groupBy("block").applyInArrow(send_first, _SENT), 2)
    for n in range(3, order + 1):
        sent = rows.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(sender(n), _SENT)
        sums = sums.unionByName(added(sent, n))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in carried), "n_words bigint", "log_score double", "mean_log_score double"])
    done = rows.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(fuse, schema)
    names = dict(zip(plain.columns, docs.columns))
    kept = docs.drop(text)
    return done.select(*[F.col(c).alias(names[c]) for c in carried], *[F.col(c).alias(sql_name(kept, c)) for c in ("n_words", "log_score", "mean_log_score")])


def op3_lm_score(spark, sf_dir: str) -> DataFrame:
    done = score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))
