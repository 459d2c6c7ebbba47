"""Operator 6, URL filters: pattern rules indexed by their rarest literal token.

A pattern is matched against ``host + path`` (and, after it, query and fragment):

* ``||name`` at the beginning: the host itself or any subdomain of it;
* ``|`` at the beginning or end: that edge of the url;
* ``*``: any signs; ``^``: one sign that is no letter, digit, ``_``, ``-``, ``.`` or ``%``, or the end;
* all else stands for itself.

Tokens are runs of ASCII letters and digits in lower case.  A rule's tokens are those its
pattern spells out completely; it is filed under the one that is rarest in the urls
(counted over all of them).  A url's tokens fetch candidate rules and only those run
their regular expressions.  Rules without such a token are candidates for every url.

Rules up to ``RULE_BYTES`` are held by every task, so urls are judged where they are
read, with no shuffle.  More rules take a pass for each piece of that size; the best rule of
the passes before goes along in the shared folder.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.shared import Scratch, sql_name

#: Bytes of patterns that a task holds at once.
RULE_BYTES = 8 << 20
#: Tokens of rules that are broadcast, at most, to be counted in the urls.
TOKENS = 1_000_000
_TOKEN = re.compile("[0-9a-z]+")


@dataclass(frozen=True)
class Rule:
    """``name`` is reported; of several rules that fit, the highest ``rank`` wins, then the longest pattern, then the first in order of name."""

    pattern: str
    verdict: str
    name: str | None = None
    rank: int = 0


def regular_expression(pattern: str) -> str:
    body, begin, end = pattern, "", ""
    if body.startswith("||"):
        body, begin = body[2:], r"\A(?:[^/?#]*\.)?"
    elif body.startswith("|"):
        body, begin = body[1:], r"\A"
    if body.endswith("|"):
        body, end = body[:-1], r"\Z"
    signs = {"*": ".*", "^": r"(?:[^0-9A-Za-z_.%-]|\Z)"}
    return begin + "".join(signs.get(c) or re.escape(c) for c in body) + end


def literal_tokens(pattern: str) -> set[str]:
    """Tokens that every url which the pattern matches has whole."""
    begin = 2 if pattern.startswith("||") else 1 if pattern.startswith("|") else 0
    body = pattern[begin:].lower()
    stop = body.endswith("|")
    body = body[:-1] if stop else body
    found = set()
    for m in _TOKEN.finditer(body):
        left = body[m.start() - 1] != "*" if m.start() else begin > 0
        right = body[m.end()] != "*" if m.end() < len(body) else stop
        if left and right and pattern.isascii():
            found.add(m[0])
    return found


def split_url(url: str | None) -> tuple[str, str, str]:
    """(host, path, rest): the host with A-Z in lower case; all empty without ``://``."""
    if url is None or "://" not in url:
        return "", "", ""
    after = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", after)[0]
    path = re.match(r"[^?#]*", after[len(host) :])[0]
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    return lower, path, after[len(host) + len(path) :]


class Index:
    def __init__(self, rules: list[Rule], seen: dict[str, int]):
        self.by_token: dict[str, list] = defaultdict(list)
        self.always = []
        for rule in rules:
            entry = (rule.rank, len(rule.pattern), rule.name or rule.pattern, rule, re.compile(regular_expression(rule.pattern), re.DOTALL))
            tokens = literal_tokens(rule.pattern)
            if tokens:
                self.by_token[min(tokens, key=lambda t: (seen.get(t, 0), t))].append(entry)
            else:
                self.always.append(entry)

    def best(self, text: str, tokens: set[str]):
        found = None
        for entries in (*(self.by_token[t] for t in tokens if t in self.by_token), self.always):
            for e in entries:
                if (found is None or better(e, found)) and e[4].search(text):
                    found = e
        return found


def better(a, b) -> bool:
    return (a[0], a[1]) > (b[0], b[1]) or (a[0], a[1]) == (b[0], b[1]) and a[2] < b[2]


def token_counts(urls: DataFrame, url: str, tokens: set[str]) -> dict[str, int]:
    """Urls that have each of the rules' tokens: one row per such token at most."""
    spark = urls.sparkSession
    wanted = spark.createDataFrame([(t,) for t in sorted(tokens)], "token string")
    split = urls.select(F.explode(F.array_distinct(F.split(F.lower(F.col(url)), "[^0-9a-z]+"))).alias("token"))
    held = F.broadcast(wanted) if len(tokens) <= TOKENS else wanted
    return {r["token"]: r["n"] for r in split.join(held, "token").groupBy("token").agg(F.count("*").alias("n")).collect()}


def filter_urls(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow", rule_bytes: int = RULE_BYTES) -> DataFrame:
    """The pages with ``host``, ``path``, ``rule`` (name of the rule that won, or null) and ``verdict``.

    A null url, or one without ``://``, has empty host and path, fits no pattern that
    spells out anything, and gets ``default``.  Ties between equal rules go by name.  All
    rows and columns stay; an empty table gives an empty table.
    """
    tokens = set().union(*(literal_tokens(r.pattern) for r in rules)) if rules else set()
    seen = token_counts(pages, url, tokens) if tokens else {}
    pieces: list[list[Rule]] = [[]]
    room = rule_bytes
    for r in rules:
        if len(r.pattern) > room and pieces[-1]:
            pieces.append([])
            room = rule_bytes
        pieces[-1].append(r)
        room -= len(r.pattern)
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession, "urls")
    plain = pages.toDF(*[f"c{i}" for i in range(len(pages.columns))])
    body = plain.columns[pages.columns.index(url)]
    for k, piece in enumerate(pieces):
        counts = {t: seen[t] for r in piece for t in literal_tokens(r.pattern) if t in seen}
        plain = plain.withColumn("now", _judge(spark.sparkContext.broadcast((piece, counts)))(F.col(body).cast("string")))
        if k:  # a rule goes before another by rank, then length, then name
            old, new = F.col("best"), F.col("now")
            ahead = lambda x: F.struct(x["rank"], x["length"])
            wins = old["name"].isNull() | (ahead(new) > ahead(old)) | ((ahead(new) == ahead(old)) & (new["name"] < old["name"]))
            plain = plain.withColumn("best", F.when(new["name"].isNotNull() & wins, new).otherwise(old)).drop("now")
        else:
            plain = plain.withColumnRenamed("now", "best")
        if k < len(pieces) - 1:
            plain = scratch.write(plain)
    found = lambda c: F.coalesce("best.verdict", F.lit(default)) if c == "verdict" else F.col(f"best.{c}")
    return plain.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(pages.columns)], *[found(c).alias(sql_name(pages, c)) for c in ("host", "path", "rule", "verdict")])


def _judge(held):
    """Column function of a url: its host and path, and the best rule of a piece."""
    built: list[Index] = []  # of this worker, at its first batch

    @F.arrow_udf("struct<host string, path string, rule string, verdict string, rank int, length int, name string>")
    def judge(column: pa.Array) -> pa.Array:
        if not built:
            built.append(Index(*held.value))
        split = [split_url(u) for u in column.to_pylist()]
        best = [built[0].best(t, set(_TOKEN.findall(t.lower()))) if (t := "".join(s)) else None for s in split]
        of = lambda f, kind: pa.array([f(e) if e else None for e in best], kind)
        return pa.StructArray.from_arrays(
            [
                pa.array([s[0] for s in split], pa.string()),
                pa.array([s[1] for s in split], pa.string()),
                of(lambda e: e[3].name, pa.string()),
                of(lambda e: e[3].verdict, pa.string()),
                of(lambda e: e[0], pa.int32()),
                of(lambda e: e[1], pa.int32()),
                of(lambda e: e[2], pa.string()),
            ],
            ["host", "path", "rule", "verdict", "rank", "length", "name"],
        )

    return judge


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host, its subdomains, and paths that begin with ``path``; these go before patterns."""
    return Rule(f"||{host}{path}", verdict, host + path, rank=1)


HOST_RULES = [host_rule("net", "/", "block"), host_rule("example.net", "/en/", "allow"), host_rule("example.com", "/de/", "block"), host_rule("org", "/fr/", "allow")]
#: Unnamed patterns, judged where no host rule fits.
PATTERNS = [Rule("||spam-farm.", "block"), Rule("/ads/", "block"), Rule("/login^", "block"), Rule("casino", "block"), Rule("/cart^", "block"), Rule("*.exe|", "block"), Rule("/robots.txt|", "block")]


def op6_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, HOST_RULES + PATTERNS).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = r"""
WITH split AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after FROM pages
), parts AS (
  SELECT page_id, regexp_extract(after, '^[^/?#]*') AS raw, after FROM split
), hosts AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(after, length(raw) + 1), '^[^?#]*') AS path, substr(after, length(raw) + 1) AS tail FROM parts
), named AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM hosts
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN host LIKE 'spam-farm.%' OR host LIKE '%.spam-farm.%' OR host || tail LIKE '%/ads/%' OR host || tail LIKE '%casino%'
    OR host || tail LIKE '%.exe' OR host || tail LIKE '%/robots.txt'
    OR regexp_matches(host || tail, '/(login|cart)([^0-9A-Za-z_.%-]|$)') THEN 'block'
  ELSE 'allow' END AS verdict
FROM named
"""
