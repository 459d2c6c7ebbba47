"""Helpers that several operators share: checkpoints, text blocks, vectorised words.

Texts reach Python as Arrow batches of whole texts.  Words are found with numpy over
the bytes of many texts at once: all word classes used here treat every non-ASCII
byte alike, so UTF-8 bytes can be classified without decoding.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by the numpy code of a task; features take about fifty times as many bytes of memory.
SLICE_BYTES = 1 << 18

_B = np.uint64(0x9E3779B97F4A7C15)
_WINDOW_BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


# ---------------------------------------------------------------- checkpoints


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Where it is unset a local master gets a temporary folder, as in tests; a cluster gets a ValueError,
    since its executors don't share such folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.getCheckpointDir():
        return spark.sparkContext.getCheckpointDir().rsplit("/", 1)[0]
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="llm-checkpoint-")
    spark.sparkContext.setCheckpointDir(made)
    return f"file://{made}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path for a table of files in the shared folder."""
    return f"{shared_dir(spark)}/llm-{what}-{uuid.uuid4().hex}"


class Scratch:
    """Tables in the shared folder that cut the lineage of iterative work.

    Unlike checkpoints they tell Spark their true sizes, so rounds of joins don't multiply
    estimates and small tables are broadcast; and they are removed once superseded.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.home, self.paths = spark, shared_path(spark, what), {}

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.home}/{len(self.paths)}"
        df.write.option("compression", "zstd").parquet(path)
        made = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(made)] = (path, made)  # the frame is kept, so its id stays its own
        return made

    def remove(self, *tables: DataFrame) -> None:
        """Delete tables that nothing lazy reads any more."""
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths[id(t)][0])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


# --------------------------------------------------------------------- blocks


def count_blocks(docs: DataFrame, text: str, block_bytes: int, least: int = 16) -> int:
    """How many blocks of about ``block_bytes`` bytes of text the documents make."""
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return max(least, -(-int(total) // block_bytes))


def with_blocks(docs: DataFrame, blocks: int, *columns: str) -> DataFrame:
    """Add ``block``, a hash of the row's own values: a lost task that reruns builds the same blocks."""
    return docs.withColumn("block", F.pmod(F.xxhash64(*columns), F.lit(blocks)).cast("int"))


# ---------------------------------------------------------------------- words


def byte_table(*, stop: str | None = None, keep: str | None = None) -> np.ndarray:
    """True for the bytes of words: all but ``stop``, or ``keep`` and every non-ASCII byte."""
    table = np.zeros(256, dtype=bool)
    if stop is not None:
        table[:] = True
        table[[ord(c) for c in stop]] = False
    else:
        table[[ord(c) for c in keep]] = True
        table[128:] = True
    return table


#: Words [^\x20\x09-\x0D]+
SPACED = byte_table(stop="\x20\x09\x0a\x0b\x0c\x0d")
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
ALNUM = byte_table(keep="0123456789abcdefghijklmnopqrstuvwxyz")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown as needed."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            for name, base in (("up", self.base), ("down", self.inverse)):
                x = np.full(size, base, dtype=np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


_byte_powers = Powers(_B)
_lanes = [Powers(b) for b in _WINDOW_BASES]


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of some texts.

    ``data``: their bytes, each text followed by one space; ``starts``/``ends``: the
    words' places in it; ``first``: for each text the number of words before it (one
    entry more than texts).
    """

    def __init__(self, texts: list[bytes | None], table: np.ndarray, lower: bool = False):
        self.data = np.frombuffer(b" ".join([t or b"" for t in texts]) + b" ", dtype=np.uint8)
        if lower:
            self.data = _LOWER[self.data]
        lengths = np.fromiter((len(t) if t else 0 for t in texts), dtype=np.int64, count=len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(lengths + 1)])
        inside = table[self.data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        self.starts, self.ends = edge[0::2], edge[1::2]  # the last byte is a space, so words end
        self.first = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial of its bytes, mixed."""
        up, _ = _byte_powers.upto(len(self.data) + 1)
        down = _byte_powers.down
        total = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * down[self.starts])

    def compact(self) -> tuple[bytes, np.ndarray]:
        """All words joined by single spaces (one after the last too), and where each starts, with the end."""
        sizes = self.ends - self.starts + 1
        at = np.concatenate([[0], np.cumsum(sizes)])
        mark = np.zeros(len(self.data) + 1, dtype=np.int8)
        mark[self.starts] += 1
        mark[self.ends + 1] -= 1
        keep = np.cumsum(mark[:-1], dtype=np.int8) > 0
        data = self.data.copy()
        data[self.ends] = 32
        return data[keep].tobytes(), at

    def windows(self, length: int) -> np.ndarray:
        """Words at which a window of ``length`` words of one text starts."""
        n = self.counts() - length + 1
        n = np.where(n > 0, n, 0)
        return ranges(self.first[:-1], n)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... counts[0] of them, then those of the next."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(total)


def rolling(hashes: np.ndarray, at: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
    """Rabin-Karp hash (modulo 2**64) of the ``length`` word hashes from each of ``at`` on."""
    up, _ = _lanes[lane].upto(len(hashes) + 1)
    down = _lanes[lane].down
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[at + length] - total[at]) * down[at])


def covered(n: int, at: np.ndarray, length) -> np.ndarray:
    """Which of n words lie in a window of ``length`` words that starts at one of ``at``."""
    mark = np.zeros(n + 1, dtype=np.int64)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + length, -1)
    return np.cumsum(mark[:-1]) > 0


def slices(texts: list[bytes | None], limit: int = SLICE_BYTES):
    """Ranges of texts of about ``limit`` bytes; a longer text stands alone, whole."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t) + 1 if t else 1
        if i > begin and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.to_pylist()


def as_binary(text: str):
    """The text's UTF-8 bytes, so that Python gets them undecoded."""
    return F.col(text).cast("string").cast("binary")


def word_count(text: str):
    """Number of [^\\x20\\x09-\\x0D]+ in a text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


# ----------------------------------------------------------------- union-find


def local_components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 the smallest node of each one's component, within one task."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        np.minimum.at(label, before[left], low)
        np.minimum.at(label, before[right], low)
        while True:  # shortcut
            up = label[label]
            if (up == label).all():
                break
            label = up
        if (label == before).all():
            break
    return label


def bits_set(x: np.ndarray) -> np.ndarray:
    """Bits set in each 64-bit value."""
    return np.bitwise_count(x)


def sql_name(df: DataFrame, wanted: str) -> str:
    """A column name not used by ``df``, for helper columns beside clashing ones."""
    used = {c.lower() for c in df.columns}
    while wanted.lower() in used:
        wanted = f"_{wanted}"
    return wanted

