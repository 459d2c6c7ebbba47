"""Operator 9, language ID by Bayesian evidence fusion.

For each page: log likelihoods of the visible text's letter trigrams under each language's
model, the language declared in the markup, the language named in the address, and the
prior of its host.  Host priors are smoothed hierarchically: a host leans on its
registered domain, that on its suffix, that on all pages.  They are sums of the pages' own
posteriors, made by grouped aggregation at each level.

Models are fitted to ``SAMPLE`` documents of each language at most, chosen by hash; every
page is classified over its whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.shared import Scratch, as_binary, byte_table, checkpoint, slices, sql_name, texts_of

#: Documents per language that models are fitted to, languages at most, and buckets of hashed trigrams.
SAMPLE, LANGUAGES, BUCKETS = 1500, 200, 1 << 14
#: Trigrams repeat each other, so a text counts as this many independent ones at most.
TRUST = 60.0
#: Probability that a declaration, or the address, names the right language.
DECLARED, ADDRESS = 0.9, 0.85
#: Pages' worth of its parent's distribution that a host, a domain and a suffix start with.
STRENGTH = 4.0

_LETTERS = byte_table(keep="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def visible_text(html: str):
    """The words of a page outside tags, scripts, styles, navigation and comments."""
    plain = F.regexp_replace(F.col(html), r"(?is)<(script|style|nav|head)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.coalesce(plain, F.lit(""))


def trigrams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every trigram of bytes, letters in lower case and one space for all else."""
    data = np.frombuffer(b" ".join([t or b"" for t in texts]) + b"   ", dtype=np.uint8)
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    letters = _LETTERS[data]
    keep = letters | np.concatenate([[True], letters[:-1]])
    code = np.where(letters, _LOWER[data], 32)[keep].astype(np.uint32)
    whose = np.searchsorted(ends, np.flatnonzero(keep), side="right")
    if len(code) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    gram = code[:-2] << 16 | code[1:-1] << 8 | code[2:]
    same = (whose[:-2] == whose[2:]) & (whose[2:] < len(texts))
    return whose[:-2][same], ((gram * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)[same]


class Model:
    """``logs``: (languages, BUCKETS) log probabilities."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.5
        self.logs = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32).copy() if len(languages) else np.zeros((BUCKETS, 0), dtype=np.float32)

    def likelihoods(self, texts: list[bytes | None]) -> np.ndarray:
        """(texts, languages): mean log likelihood of a trigram times their number, ``TRUST`` at most."""
        out = np.zeros((len(texts), len(self.languages)))
        for a, b in slices(texts):
            whose, bucket = trigrams(texts[a:b])
            n = np.bincount(whose, minlength=b - a)
            for k in range(len(self.languages)):
                out[a:b, k] = np.bincount(whose, self.logs[bucket, k], minlength=b - a) * np.minimum(1.0, TRUST / np.maximum(n, 1))
        return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Trigram counts of at most ``sample`` documents a language (by hash of the text); null languages don't count.

    Raises ValueError if there are more than LANGUAGES languages.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.lower(lang).alias("known"), as_binary(text).alias("body"))
    sizes = known.groupBy("known").count().limit(LANGUAGES + 1).collect()  # as many rows as languages
    if len(sizes) > LANGUAGES:
        raise ValueError(f"there are more than {LANGUAGES} languages")
    languages = sorted(r["known"] for r in sizes)
    share = {r["known"]: min(1.0, sample / r["count"]) for r in sizes}
    if not languages:
        return Model([], np.zeros((0, BUCKETS)))
    place = {x: i for i, x in enumerate(languages)}
    rate = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(int(share[k] * 1_000_000)))])
    chosen = known.where(F.pmod(F.xxhash64("body"), F.lit(1_000_000)) < rate[F.col("known")])

    def count(batches):
        total = np.zeros((len(languages), BUCKETS), dtype=np.int64)
        for batch in batches:
            which, texts = batch["known"].to_pylist(), texts_of(batch["body"])
            for a, b in slices(texts):
                whose, bucket = trigrams(texts[a:b])
                row = np.array([place[x] for x in which[a:b]])
                total += np.bincount(row[whose] * BUCKETS + bucket, minlength=total.size).reshape(total.shape)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.reshape(-1)[at])], ["at", "n"])

    counts = np.zeros(len(languages) * BUCKETS)
    for r in chosen.mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas().itertuples():  # languages * BUCKETS rows at most
        counts[r.at] = r.n
    return Model(languages, counts.reshape(len(languages), BUCKETS))


def identify(pages: DataFrame, model: Model, url: str = "url", html: str = "html") -> DataFrame:
    """The pages with ``lang`` (most probable; ties: first in order), ``confidence``, ``declared``, ``address`` and ``host``.

    Null or empty html gives no text evidence, a null url no address or host evidence; pages
    without a host share one prior, that of all pages.  Unknown languages declared count as
    nothing.  All rows and all columns but ``html`` stay (evidence is kept in the shared
    folder between its two uses, and markup is too large for that); an empty table gives an
    empty table; a model of no languages gives null.
    """
    spark, n = pages.sparkSession, len(model.languages)
    carried = [c for c in pages.columns if c != html]
    names = {c: sql_name(pages, c) for c in ("lang", "confidence", "declared", "address", "host")}
    if not n:
        return pages.select(*carried, F.lit(None).cast("string").alias(names["lang"]), F.lit(None).cast("double").alias(names["confidence"]), *[F.lit(None).cast("string").alias(names[c]) for c in ("declared", "address", "host")])
    held = spark.sparkContext.broadcast(model)  # languages * BUCKETS numbers

    @F.arrow_udf("array<double>")
    def likelihood(column: pa.Array) -> pa.Array:
        return pa.array(held.value.likelihoods(texts_of(column)).tolist(), pa.list_(pa.float64()))

    languages = F.array(*[F.lit(x) for x in model.languages])
    known = lambda c: F.when(F.array_contains(languages, c), c)
    after = F.split_part(F.col(url), F.lit("://"), F.lit(2))
    host = F.nullif(F.lower(F.regexp_extract(after, r"^[^/?#:]*", 0)), F.lit(""))
    path_lang = F.lower(F.regexp_extract(after, r"^[^/?#]*/([A-Za-z]{2,3})(?:[-_][A-Za-z]+)?(?:[/?#]|$)", 1))
    suffix = F.regexp_extract(host, r"([^.]*)$", 1)
    declared = F.lower(F.regexp_extract(F.col(html), r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    body = pages.withColumn(names["host"], host).withColumn(names["declared"], known(declared)).withColumn(names["address"], F.coalesce(known(path_lang), known(suffix)))
    logs = sql_name(body, "logs")
    say = lambda column, p: F.when(column.isNull(), F.array(*[F.lit(0.0)] * n)).otherwise(
        F.transform(languages, lambda x: F.when(x == column, F.lit(float(np.log(p)))).otherwise(F.lit(float(np.log((1 - p) / max(n - 1, 1))))))
    )
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    heard = body.withColumn(logs, add(likelihood(visible_text(html).cast("binary")), add(say(F.col(names["declared"]), DECLARED), say(F.col(names["address"]), ADDRESS))))
    heard = checkpoint(heard.drop(html))

    own = heard.select(F.col(names["host"]).alias("h"), _softmax(F.col(logs)).alias("p"))
    sums = own.groupBy("h").agg(*[F.sum(F.col("p")[k]).alias(f"s{k}") for k in range(n)])
    hosts = checkpoint(sums.where("h is not null").select("h", F.regexp_extract("h", r"([^.]*\.[^.]*)$", 1).alias("d"), F.regexp_extract("h", r"([^.]*)$", 1).alias("x"), *[f"s{k}" for k in range(n)]))
    total = [F.sum(f"s{k}").alias(f"s{k}") for k in range(n)]
    world = sums.agg(*total).first()
    seen = sum(world[k] or 0.0 for k in range(n)) or 1.0
    base = [((world[k] or 0.0) + 1.0) / (seen + n) for k in range(n)]

    def prior(level: DataFrame, parent) -> list:
        mass = sum((F.col(f"s{k}") for k in range(1, n)), F.col("s0"))
        return [((F.col(f"s{k}") + STRENGTH * parent[k]) / (mass + STRENGTH)) for k in range(n)]

    suffixes = hosts.groupBy("x").agg(*total)
    suffixes = suffixes.select("x", *[p.alias(f"px{k}") for k, p in enumerate(prior(suffixes, [F.lit(b) for b in base]))])
    domains = hosts.groupBy("x", "d").agg(*total).join(suffixes, "x")
    domains = domains.select("x", "d", *[p.alias(f"pd{k}") for k, p in enumerate(prior(domains, [F.col(f"px{k}") for k in range(n)]))])
    tops = hosts.join(domains, ["x", "d"])
    priors = tops.select(F.col("h").alias("prior_h"), F.array(*[F.log(p) for p in prior(tops, [F.col(f"pd{k}") for k in range(n)])]).alias("prior_logs"))

    prior_h, prior_logs = sql_name(heard, "prior_h"), sql_name(heard, "prior_logs")
    priors = Scratch(spark, "priors").write(priors.toDF(prior_h, prior_logs))  # both sides stand by themselves, so a hot host can be split
    named = F.col(names["host"]).isNotNull()
    fused = heard.where(named).join(priors, heard[names["host"]] == priors[prior_h])
    nowhere = heard.where(~named).withColumns({prior_h: F.lit(None).cast("string"), prior_logs: F.lit(None).cast("array<double>")})
    fused = fused.unionByName(nowhere)
    everywhere = F.array(*[F.lit(float(np.log(b))) for b in base])
    final = sql_name(fused, "posterior")
    fused = fused.withColumn(final, _softmax(add(F.col(logs), F.coalesce(F.col(prior_logs), everywhere))))
    top = F.array_max(final)
    return fused.select(
        *carried, F.element_at(languages, F.array_position(final, top).cast("int")).alias(names["lang"]), top.alias(names["confidence"]), *[names[c] for c in ("declared", "address", "host")]
    )


def _softmax(column):
    top = F.array_max(column)
    e = F.transform(column, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def op9_language(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    model = train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return identify(pages, model).select("page_id", "lang", F.round("confidence", 6).alias("confidence"), "declared", "address", "host")
