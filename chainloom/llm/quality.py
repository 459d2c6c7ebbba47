"""Operator 7, quality classifier: ordinal cumulative-link regression on graded ratings.

A document's score is the sum of shared weights of its hashed text features; ordered
thresholds cut the score into grades: P(grade >= k) = logistic(score - threshold k).  The
model is fitted to a bounded sample of rated documents (``SAMPLE`` a grade, by hash of the
id); every document is scored, over its whole text.

Features are runs of letters and digits in lower case and runs of other printable signs,
hashed to ``BUCKETS`` weights, each counted once, plus the shares of some byte classes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.shared import ALNUM, Words, as_binary, byte_table, slices, sql_name, texts_of

#: Rated documents of each grade that the model is fitted to, at most.
SAMPLE = 3000
#: Grades, at most.
GRADES = 100
BUCKETS = 1 << 18
#: Runs of ASCII signs.
SIGNS = byte_table(keep="!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
SIGNS[128:] = False
_CLASSES = [byte_table(keep="ABCDEFGHIJKLMNOPQRSTUVWXYZ"), byte_table(keep="0123456789"), SIGNS.copy()]
_CLASSES[0][128:] = _CLASSES[1][128:] = False
DENSE = 6


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each feature, bucket of each, dense): distinct hashed runs, and dense numbers per text."""
    whose, bucket = [], []
    sizes = np.fromiter((len(t or b"") for t in texts), dtype=np.float64, count=len(texts))
    words = Words(texts, ALNUM, lower=True)
    signs = Words(texts, SIGNS)
    raw = Words(texts, SIGNS).data
    for part, salt in ((words, 0), (signs, 1)):
        whose.append(np.repeat(np.arange(len(texts)), part.counts()))
        h = part.hashes() if len(part) else np.zeros(0, dtype=np.uint64)
        bucket.append(((h >> np.uint64(20)) + np.uint64(salt * 7919)) % np.uint64(BUCKETS))
    key = np.unique(np.concatenate(whose).astype(np.int64) * BUCKETS + np.concatenate(bucket).astype(np.int64))
    dense = np.zeros((len(texts), DENSE))
    for i, table in enumerate(_CLASSES):
        total = np.concatenate([[0], np.cumsum(table[raw])])
        dense[:, i] = (total[words.offsets[1:]] - total[words.offsets[:-1]]) / np.maximum(sizes, 1)
    n = words.counts()
    long = np.concatenate([[0], np.cumsum(words.ends - words.starts)])
    dense[:, 3] = np.log1p(n) / 10
    dense[:, 4] = (long[words.first[1:]] - long[words.first[:-1]]) / np.maximum(n, 1) / 10
    dense[:, 5] = np.bincount(key // BUCKETS, minlength=len(texts)) / np.maximum(n + signs.counts(), 1)
    return key // BUCKETS, key % BUCKETS, dense


@dataclass
class Model:
    """Weights by bucket, dense weights, thresholds between neighbouring grades, and the grades."""

    weights: np.ndarray
    dense: np.ndarray
    thresholds: np.ndarray
    grades: list[int]

    def tails(self, texts: list[bytes | None]) -> np.ndarray:
        """(texts, grades - 1): P(grade >= grades[k + 1])."""
        score = np.zeros(len(texts))
        for a, b in slices(texts):
            whose, bucket, dense = features(texts[a:b])
            score[a:b] = np.bincount(whose, self.weights[bucket].astype(np.float64), minlength=b - a) + dense @ self.dense
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def log_ratio(whose: np.ndarray, local: np.ndarray, top: np.ndarray, n: int, prior: float = 4.0, least: float = 2.5) -> np.ndarray:
    """Log ratio of each feature's counts in the best-graded documents and in the others, to what chance gives.

    ``prior`` documents are added as chance would share them.  Counts within ``least``
    standard deviations of chance say nothing (0), so few ratings don't fit noise.
    """
    good, bad = (np.bincount(local, side[whose], minlength=n) for side in (top.astype(float), (~top).astype(float)))
    share = min(max(top.mean(), 1e-3), 1 - 1e-3)
    ratio = np.log(good / share + prior) - np.log(bad / (1 - share) + prior)
    off = np.abs(bad - (good + bad) * (1 - share)) / np.sqrt((good + bad) * share * (1 - share) + 1)
    return np.where(off > least, ratio, 0.0)


def fit_ordinal(whose: np.ndarray, bucket: np.ndarray, dense: np.ndarray, grade: np.ndarray, weight: np.ndarray, grades: list[int], steps: int = 200, l2: float = 1e-4) -> Model:
    """Maximum likelihood by Adam; thresholds are a first one and positive gaps, so they stay in order.

    Features enter scaled by their log ratio, so rare words that say nothing stay near zero.
    """
    k = len(grades) - 1
    used, local = np.unique(bucket, return_inverse=True)
    level = np.searchsorted(grades, grade)
    ratio = log_ratio(whose, local, level == k, len(used))
    value = ratio[local]
    cuts = np.cumsum([0, len(used), dense.shape[1], 1, k - 1])
    x = np.zeros(cuts[-1])
    m, v = np.zeros_like(x), np.zeros_like(x)
    n, row = weight.sum(), np.arange(len(level))
    for t in range(1, steps + 1):
        w, d = x[: cuts[1]], x[cuts[1] : cuts[2]]
        gaps = np.exp(x[cuts[3] :])
        theta = np.concatenate([x[cuts[2] : cuts[3]], x[cuts[2]] + np.cumsum(gaps)])
        score = np.bincount(whose, w[local] * value, minlength=len(level)) + dense @ d
        tail = np.concatenate([np.ones((len(level), 1)), 1 / (1 + np.exp(np.clip(theta[None, :] - score[:, None], -30, 30))), np.zeros((len(level), 1))], axis=1)
        p = np.maximum(tail[row, level] - tail[row, level + 1], 1e-12)
        slope = tail * (1 - tail)  # of each tail by the score; 0 at the ends
        up, low = slope[row, level] / p * weight / n, slope[row, level + 1] / p * weight / n
        by_score = low - up
        by_theta = np.array([up[level == j + 1].sum() - low[level == j].sum() for j in range(k)])
        g = np.concatenate([np.bincount(local, by_score[whose] * value, minlength=len(used)), dense.T @ by_score, [by_theta.sum()], np.cumsum(by_theta[::-1])[::-1][1:] * gaps])
        g[: cuts[2]] += l2 * x[: cuts[2]]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(BUCKETS, dtype=np.float32)
    weights[used] = x[: cuts[1]] * ratio
    gaps = np.exp(x[cuts[3] :])
    return Model(weights, x[cuts[1] : cuts[2]], np.concatenate([x[cuts[2] : cuts[3]], x[cuts[2]] + np.cumsum(gaps)]), grades)


def train(docs: DataFrame, ratings: DataFrame, doc_id: str = "doc_id", text: str = "text", grade: str = "grade", sample: int = SAMPLE) -> Model:
    """Fit to at most ``sample`` documents of each grade, chosen by a hash of the id.

    Rows with a null id or grade don't count; a document of several ratings has the lowest.  With fewer than two grades every document
    gets the probability 1/2 or, with one, that grade.  Raises ValueError if there are more
    than GRADES grades.
    """
    clean = ratings.select(F.col(doc_id).alias("rated"), F.col(grade).cast("int").alias("rating")).where("rated is not null and rating is not null").groupBy("rated").agg(F.min("rating").alias("rating"))
    grades = sorted(r["rating"] for r in clean.select("rating").distinct().limit(GRADES + 1).collect())
    if len(grades) > GRADES:
        raise ValueError(f"there are more than {GRADES} grades")
    if len(grades) < 2:
        return Model(np.zeros(BUCKETS, dtype=np.float32), np.zeros(DENSE), np.full(max(len(grades) - 1, 0), 0.0), grades or [0])
    by_hash = F.xxhash64("rated")
    chosen = clean.where(F.col("rating") == grades[0]).orderBy(by_hash, "rated").limit(sample)
    for g in grades[1:]:
        chosen = chosen.unionByName(clean.where(F.col("rating") == g).orderBy(by_hash, "rated").limit(sample))
    rated = docs.select(F.col(doc_id).alias("rated"), as_binary(text).alias("body")).join(F.broadcast(chosen), "rated")  # sample * grades rows at most

    def extract(batches):
        for batch in batches:
            texts, rating = texts_of(batch["body"]), batch["rating"].to_pylist()
            for a, b in slices(texts):
                whose, bucket, dense = features(texts[a:b])
                ends = np.searchsorted(whose, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rating[a:b], pa.int32()), pa.array([bucket[x:y].astype("<u4").tobytes() for x, y in zip(ends[:-1], ends[1:])], pa.binary()), pa.array(dense.tolist(), pa.list_(pa.float64()))],
                    ["rating", "buckets", "dense"],
                )

    # a bounded sample: the distinct features of sample * grades documents
    rows = rated.mapInArrow(extract, "rating int, buckets binary, dense array<double>").toPandas()
    if rows.empty or rows.rating.nunique() < 2:
        return Model(np.zeros(BUCKETS, dtype=np.float32), np.zeros(DENSE), np.zeros(len(grades) - 1), grades)
    rows = rows.sort_values(["rating", "buckets"], kind="stable")
    grades = sorted(set(rows.rating))
    lists = [np.frombuffer(x, dtype="<u4") for x in rows.buckets]
    whose = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    rating = rows.rating.to_numpy()
    best = rating == grades[-1]  # the best grade and all others weigh the same
    weight = np.where(best, 0.5 / best.mean(), 0.5 / (1 - best.mean()))
    return fit_ordinal(whose, np.concatenate(lists).astype(np.int64), np.array(rows.dense.tolist()), rating, weight, grades)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with ``expected_grade`` and ``tail`` (the probability of the highest grade).

    Null and empty texts have no features but are scored like any other.  All columns and
    rows stay, repeated ones too; an empty table gives an empty table.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights, 1 MB

    @F.arrow_udf("struct<expected_grade double, tail double>")
    def grade_of(column: pa.Array) -> pa.Array:
        m = held.value
        tails = m.tails(texts_of(column))
        steps = np.diff(m.grades) if len(m.grades) > 1 else np.zeros(0)
        top = tails[:, -1] if tails.shape[1] else np.ones(len(tails))
        return pa.StructArray.from_arrays([pa.array(m.grades[0] + tails @ steps), pa.array(top)], ["expected_grade", "tail"])

    name = sql_name(docs, "graded")
    out = docs.withColumn(name, grade_of(as_binary(text)))
    return out.select(*docs.columns, *[F.col(f"{name}.{c}").alias(sql_name(docs, c)) for c in ("expected_grade", "tail")])


def ratings_of(labels: DataFrame) -> DataFrame:
    """Graded ratings of labelled documents: a point each for quality and for not being toxic."""
    return labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade"))


#: Documents stay whose probability of the highest grade is at least this.
THRESHOLD = 0.5


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, ratings_of(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    done = score(docs, model)
    return done.select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("tail", 6).alias("tail"), (F.col("tail") >= THRESHOLD).alias("keep"))
