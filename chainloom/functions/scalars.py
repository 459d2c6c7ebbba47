"""Scalar functions over columns, all of them built of Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chainloom.config import LITERAL_ZERO


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def effective_tag(tag, stable: int) -> Column:
    """0 stands for the stable tag, the largest unsigned 32-bit number for 0."""
    t = _col(tag).cast("bigint")
    return F.when(t == 0, F.lit(stable)).when(t == LITERAL_ZERO, F.lit(0)).otherwise(t).cast("bigint")


def has_0x(s) -> Column:
    return _col(s).rlike("^0[xX]")


def _digits(s) -> Column:
    """What stands after 0x."""
    return F.substr(_col(s), F.lit(3))


def clean_hex(s) -> Column:
    """Hex digits without 0x and leading zeros; empty: 0."""
    digits = F.ltrim(F.regexp_replace(F.lower(_col(s)), "^0x", ""), F.lit("0"))
    return F.coalesce(F.nullif(digits, F.lit("")), F.when(_col(s).isNotNull(), F.lit("0")))


def hex_to_long(s) -> Column:
    """A 0x quantity of up to 63 bits; null if it isn't one."""
    return F.when(_col(s).rlike("^0[xX]0*(?:[0-7][0-9a-fA-F]{15}|[0-9a-fA-F]{1,15})$"), F.conv(F.right(_digits(s), F.lit(16)), 16, 10).cast("bigint"))


def hex_to_decimal(s) -> Column:
    """A 0x quantity as DECIMAL(38,0); null above 120 bits (use the uint256 function then) or if it isn't one."""
    return F.when(_col(s).rlike("^0[xX]0*[0-9a-fA-F]{1,30}$"), _wide(_digits(s)))


def _wide(digits: Column) -> Column:
    padded = F.lpad(F.right(digits, F.lit(30)), 30, "0")
    part = lambda start: F.conv(F.substr(padded, F.lit(start), F.lit(10)), 16, 10).cast("decimal(13,0)")
    scale = 1 << 40
    return (part(1) * F.lit(str(scale * scale)).cast("decimal(25,0)")).cast("decimal(38,0)") + (part(11) * F.lit(scale).cast("decimal(13,0)")).cast("decimal(38,0)") + part(21).cast("decimal(38,0)")


def clean_address(s) -> Column:
    """The last 40 signs, led by 0x."""
    return F.concat(F.lit("0x"), F.right(F.lower(_col(s)), F.lit(40)))


def topic_to_address(topic) -> Column:
    return clean_address(topic)


def data_words(data) -> Column:
    """The 64-digit words of 0x data."""
    return F.regexp_extract_all(F.regexp_replace(_col(data), "^0x", ""), F.lit("([0-9a-fA-F]{64})"), 1)


def truncated_error(s, limit: int = 256) -> Column:
    return F.left(_col(s), F.lit(limit))


def to_timestamp(seconds) -> Column:
    """Seconds since 1970; 0: null."""
    return F.timestamp_seconds(F.nullif(_col(seconds), F.lit(0)))


def micros_to_seconds(micros) -> Column:
    return F.floor(_col(micros).cast("bigint") / F.lit(1_000_000)).cast("bigint")


def checksum_hex(s) -> Column:
    return F.sha2(_col(s).cast("binary"), 256)


def checksum_base64(s) -> Column:
    """MD5 in base64, as stored beside payloads."""
    return F.base64(F.unhex(F.md5(_col(s).cast("binary"))))


def parent_height(h) -> Column:
    return F.greatest(_col(h) - 1, F.lit(0)).cast("bigint")


def camel_case(s) -> Column:
    """PROOF_OF_STAKE -> ProofOfStake."""
    return F.array_join(F.transform(F.split(F.lower(_col(s)), "_"), F.initcap), "")


def enum_name(s, names: list[str]) -> Column:
    """The enum's name for any case of it, or null."""
    c = F.upper(F.regexp_replace(_col(s), "-", "_"))
    return F.when(c.isin(names), c)


def mini_batch(height, start: int, size: int) -> Column:
    """Number of the batch of ``size`` heights that a height falls in."""
    return F.floor((_col(height) - F.lit(start)) / F.lit(size)).cast("bigint")


def weighted_pick(key, weights: list[int]) -> Column:
    """Index of an endpoint, by weight, the same for the same key."""
    point = F.conv(F.left(F.md5(_col(key).cast("string").cast("binary")), F.lit(8)), 16, 10).cast("bigint") % F.lit(sum(weights))
    out, end = F.lit(len(weights) - 1), sum(weights)
    for i in range(len(weights) - 2, -1, -1):
        end -= weights[i + 1]
        out = F.when(point < end, F.lit(i)).otherwise(out)
    return out.cast("int")


def moving_average(values, age: float = 10.0) -> Column:
    """Exponentially weighted moving average of an array, started at its first value."""
    share = 2.0 / (age + 1.0)
    v = _col(values)
    return F.aggregate(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), v[0].cast("double"), lambda a, x: a + (x - a) * F.lit(share))


def hysteresis(violations, most: int) -> Column:
    """Counter over an array of booleans: +1 for a violation, else -1, within 0 and ``most``."""
    return F.aggregate(_col(violations), F.lit(0), lambda a, x: F.least(F.lit(most), F.greatest(F.lit(0), a + F.when(x, 1).otherwise(-1))))


def client_id(s) -> Column:
    """A client's name for metrics: trimmed, cut at the first colon, lower case, few signs; empty: unknown."""
    name = F.lower(F.translate(F.split_part(F.trim(_col(s)), F.lit(":"), F.lit(1)), " ", "_"))
    clean = F.regexp_replace(name, r"[^\p{L}\p{N}_/-]", "")
    return F.when(F.coalesce(clean, F.lit("")) == "", F.lit("unknown")).otherwise(clean)


_METHOD = "^/([^/]+)/([^/]+)$"


def method_name(full) -> Column:
    """Service and method of a full RPC name."""
    return F.struct(F.regexp_extract(_col(full), _METHOD, 1).alias("service"), F.regexp_extract(_col(full), _METHOD, 2).alias("method"))


def object_key(chain, tag, height, hash_, codec=None) -> Column:
    """Where a payload is filed."""
    parts = [F.lit(chain.blockchain.upper()), F.lit(chain.network.upper())]
    if chain.sidechain:
        parts.append(F.lit(chain.sidechain.upper()))
    key = F.concat_ws("/", *parts, _col(tag).cast("string"), _col(height).cast("string"), _col(hash_))
    return key if codec is None else F.concat(key, F.when(_col(codec) == "GZIP", F.lit(".gzip")).otherwise(F.lit("")))


def compression_of(key) -> Column:
    return F.when(F.endswith(_col(key), F.lit(".gzip")), F.lit("GZIP")).otherwise(F.lit("NONE"))
