"""Native blocks: one nested row per block, put together from what nodes send and checked against itself.

Everything of a block stays in its row: receipts and traces are matched by position with
higher-order functions, so building blocks takes no shuffle at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainloom.functions.scalars import clean_address, hex_to_decimal, hex_to_long, to_timestamp
from chainloom.operators.parse_evm import FLAT, HEADER, RECEIPT, TRANSFER, flatten_calls, priority_fee, trace_id

NULL_ADDRESS = "0x" + "0" * 40
#: First height of Arbitrum whose traces are call trees: a fixed value.
ARBITRUM_NITRO = 22_207_818

#: Of a native transaction, in order.
TRANSACTION_FIELDS = (
    "position tx_hash from_address to_address nonce gas gas_price value type priority_fee access_list_size gas_used effective_gas_price succeeded l1_fee logs token_transfers traces"
).split()

PARITY = "array<struct<action struct<callType string, from string, to string, value string, input string>, error string, subtraces int, traceAddress array<int>, transactionHash string, type string>>"


def _once(raw: DataFrame, **parsed: Column) -> DataFrame:
    """Add parsed columns behind a generator, so that no later projection parses them again."""
    made = raw.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in parsed.items()]))).alias("_p"))
    return made.select(*raw.columns, "_p.*")


def assemble(headers: DataFrame, receipts: DataFrame, traces: DataFrame, uncles: DataFrame | None = None, authors: DataFrame | None = None) -> DataFrame:
    """Raw blocks from four or five raw tables: (height, hash, header), (hash, position, receipt), (hash, position, trace), (hash, position, uncle), (hash, author).

    Parts are gathered in order of position; a block without any gets an empty list.
    """
    def gathered(part: DataFrame, value: str, name: str) -> DataFrame:
        rows = part.groupBy("hash").agg(F.sort_array(F.collect_list(F.struct("position", value))).alias("_rows"))
        return rows.select("hash", F.transform("_rows", lambda x: x[value]).alias(name))

    out = headers
    for part, value, name in ((receipts, "receipt", "receipts"), (traces, "trace", "traces"), (uncles, "uncle", "uncles")):
        if part is None:
            out = out.withColumn(name, F.array().cast("array<string>"))
        else:
            out = out.join(gathered(part, value, name), "hash", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out.withColumn("author", F.lit(None).cast("string")) if authors is None else out.join(authors.select("hash", "author"), "hash", "left")


def uses_parity(chain: str, number) -> Column:
    """Whether a block's traces are one flat list: always on Fantom, on Arbitrum before its upgrade."""
    if chain == "arbitrum":
        return number < ARBITRUM_NITRO
    return F.lit(chain == "fantom")


def _token_transfers(logs) -> Column:
    """ERC-20 and ERC-721 transfers of a list of logs; values stay 64 hex digits."""
    def word(x):
        return F.when(F.size(x["topics"]) == 3, x["data"]).otherwise(F.get(x["topics"], F.lit(3)))

    def good(x):
        return F.size(x["topics"]).isin(3, 4) & (F.lower(F.get(x["topics"], F.lit(0))) == TRANSFER) & word(x).rlike("^0x0*[0-9a-fA-F]{0,64}$") & ((F.size(x["topics"]) == 3) | (F.length(word(x)) == 66))

    def made(x):
        return F.struct(
            hex_to_long(x["logIndex"]).alias("log_index"),
            F.lower(x["address"]).alias("token"),
            clean_address(F.get(x["topics"], F.lit(1))).alias("from_address"),
            clean_address(F.get(x["topics"], F.lit(2))).alias("to_address"),
            F.when(F.size(x["topics"]) == 3, "ERC20").otherwise("ERC721").alias("standard"),
            F.lower(F.lpad(F.right(F.substr(word(x), F.lit(3)), F.lit(64)), 64, "0")).alias("value_hex"),
        )

    return F.transform(F.filter(logs, good), made)


def _parity_traces(flat, tx_hash) -> Column:
    """A transaction's traces of a block's flat list; an error is inherited from the nearest caller that has one."""
    own = F.filter(flat, lambda x: F.lower(x["transactionHash"]) == tx_hash)

    def made(x):
        above = F.filter(own, lambda y: y["error"].isNotNull() & (F.size(y["traceAddress"]) <= F.size(x["traceAddress"])) & (F.slice(x["traceAddress"], F.lit(1), F.size(y["traceAddress"])) == y["traceAddress"]))
        error = F.array_max(F.transform(above, lambda y: F.struct(F.size(y["traceAddress"]).alias("n"), y["error"].alias("error"))))["error"]
        kind = F.upper(x["type"])
        return F.struct(
            x["traceAddress"].alias("trace_address"),
            F.coalesce(F.upper(x["action"]["callType"]), kind).alias("type"),
            kind.alias("trace_type"),
            F.upper(x["action"]["callType"]).alias("call_type"),
            F.lower(x["action"]["from"]).alias("from_address"),
            F.lower(x["action"]["to"]).alias("to_address"),
            F.coalesce(hex_to_decimal(x["action"]["value"]), F.lit(0).cast("decimal(38,0)")).cast("string").alias("value"),
            x["subtraces"].alias("subtraces"),
            error.alias("error"),
            F.when(error.isNull(), 1).otherwise(0).alias("status"),
        )

    return F.transform(own, made)


def evm_blocks(raw: DataFrame, chain: str = "ethereum", with_traces: bool = True, fields: list[str] | None = None) -> DataFrame:
    """Native blocks of (header, receipts, traces, uncles, author) rows; other columns stay.

    ``transactions`` holds each transaction with its receipt, logs, token transfers and
    flat traces.  ``parse_error`` names what doesn't fit: a header without its number,
    hash or time, or other receipts or traces than the header has transactions.  Polygon's
    nodes leave the trace of a last transaction from nobody to nobody out; it gets an empty one.
    Receipts without any are those of nodes that don't keep them, as are traces.
    ``fields`` names what of each transaction is wanted (null: all); nothing else of it is
    made, and without ``traces`` no trace is parsed.  Transactions stand behind a generator,
    so that a filter on their list, as an explode brings, doesn't make them again.
    """
    traced_too = fields is None or "traces" in fields
    drop = {"header", "receipts", "traces", "uncles", "author"}
    parsed = _once(
        raw,
        h=F.from_json("header", HEADER),
        r=F.transform("receipts", lambda x: F.from_json(x, RECEIPT)),
        calls=flatten_calls("traces") if traced_too else F.lit(None).cast(T.ArrayType(FLAT)),
        parity=F.from_json(F.get("traces", F.lit(0)), PARITY) if traced_too and chain in ("arbitrum", "fantom") else F.lit(None).cast(PARITY),
        u=F.transform("uncles", lambda x: F.from_json(x, "struct<number string, hash string, miner string>")),
    )
    txs = F.coalesce("h.transactions", F.array().cast("array<" + HEADER.split("transactions array<")[1][:-1]))
    n, number, base = F.size(txs), hex_to_long("h.number"), hex_to_long("h.baseFeePerGas")
    flat = uses_parity(chain, number)
    nobody = F.lit(chain == "polygon") & (n > 0) & (F.lower(F.try_element_at(txs, F.lit(-1))["from"]) == NULL_ADDRESS) & (F.lower(F.try_element_at(txs, F.lit(-1))["to"]) == NULL_ADDRESS)

    def transaction(t, i):
        r = F.get("r", i)
        price, most, tip = (hex_to_long(t[c]) for c in ("gasPrice", "maxFeePerGas", "maxPriorityFeePerGas"))
        tx_hash = F.lower(t["hash"])
        traces = F.when(flat, _parity_traces(F.col("parity"), tx_hash)).otherwise(F.coalesce(F.get("calls", i), F.array().cast(FLAT)))
        status = hex_to_long(r["status"])
        every = (
            i.alias("position"),
            tx_hash.alias("tx_hash"),
            F.lower(t["from"]).alias("from_address"),
            F.lower(t["to"]).alias("to_address"),
            hex_to_long(t["nonce"]).alias("nonce"),
            hex_to_long(t["gas"]).alias("gas"),
            price.alias("gas_price"),
            hex_to_decimal(t["value"]).alias("value"),
            F.coalesce(hex_to_long(t["type"]), F.lit(0)).alias("type"),
            priority_fee(price, most, tip, base).alias("priority_fee"),
            F.size(F.coalesce(t["accessList"], F.array())).alias("access_list_size"),
            hex_to_long(r["gasUsed"]).alias("gas_used"),
            F.coalesce(hex_to_long(r["effectiveGasPrice"]), price).alias("effective_gas_price"),
            F.when(status.isNotNull(), status == 1).alias("succeeded"),
            hex_to_long(r["l1Fee"]).alias("l1_fee"),
            F.transform(r["logs"], lambda x: F.struct(hex_to_long(x["logIndex"]).alias("log_index"), F.lower(x["address"]).alias("address"), x["topics"].alias("topics"), x["data"].alias("data"))).alias("logs"),
            F.coalesce(_token_transfers(r["logs"]), F.array()).alias("token_transfers"),
            traces.alias("traces"),
        )
        return F.struct(*[c for c, name in zip(every, TRANSACTION_FIELDS, strict=True) if fields is None or name in fields])

    off = F.filter(
        F.transform(txs, lambda t, i: F.struct(i.alias("i"), t["hash"].alias("hash"))),
        lambda x: ~F.coalesce(
            (F.lower(F.get("r", x["i"])["transactionHash"]) == F.lower(x["hash"]))
            & (F.coalesce(hex_to_long(F.get("r", x["i"])["transactionIndex"]), x["i"]) == x["i"])
            & F.coalesce(F.lower(F.get("r", x["i"])["blockHash"]) == F.lower("h.hash"), F.lit(True))
            & F.coalesce(hex_to_long(F.get("r", x["i"])["blockNumber"]) == number, F.lit(True)),
            F.lit(False),
        ),
    )
    gone = [F.when(F.coalesce(F.col(f"h.{f}"), F.lit("")) == "", F.lit(f)) for f in ("number", "hash", "timestamp")]
    lacks = F.array_join(F.array_compact(F.array(*gone)), ",")
    traced = F.size("traces")
    errors = [
        F.when(F.col("h").isNull() | (lacks != ""), F.concat(F.lit("header lacks "), F.coalesce(F.nullif(lacks, F.lit("")), F.lit("everything")))),
        F.when((F.size("receipts") > 0) & (F.size("receipts") != n), F.format_string("%d receipts of %d transactions", F.size("receipts"), n)),
        F.when((F.size("receipts") == n) & (F.size(off) > 0), F.concat(F.lit("receipt of another transaction at "), F.get(off, F.lit(0))["i"].cast("string"))),
    ]
    if with_traces:
        enough = (traced == n) | ((traced == n - 1) & nobody)
        errors.append(F.when(~flat & (traced > 0) & ~enough, F.format_string("%d traces of %d transactions", traced, n)))
    kept = [c for c in raw.columns if c not in drop]
    made = _once(parsed, transactions=F.transform(txs, transaction))
    return made.select(
        *kept,
        number.alias("number"),
        F.lower("h.hash").alias("hash"),
        F.lower("h.parentHash").alias("parent_hash"),
        to_timestamp(hex_to_long("h.timestamp")).alias("block_ts"),
        F.lower("h.miner").alias("miner"),
        F.lower("author").alias("author"),
        base.alias("base_fee"),
        hex_to_long("h.gasUsed").alias("gas_used"),
        n.alias("n_transactions"),
        F.col("transactions"),
        F.transform("u", lambda x: F.struct(hex_to_long(x["number"]).alias("height"), F.lower(x["hash"]).alias("hash"), F.lower(x["miner"]).alias("miner"))).alias("uncles"),
        F.transform(
            F.coalesce("h.withdrawals", F.array().cast("array<struct<index string, validatorIndex string, address string, amount string>>")),
            lambda w: F.struct(hex_to_long(w["index"]).alias("withdrawal_index"), F.lower(w["address"]).alias("address"), hex_to_long(w["amount"]).alias("gwei")),
        ).alias("withdrawals"),
        F.coalesce(*errors).alias("parse_error"),
    )


def index_of(raw: DataFrame) -> DataFrame:
    """(tx_hash, block_number, block_hash) of raw blocks' transactions; only these fields of their headers are parsed."""
    light = "struct<number string, hash string, transactions array<struct<hash string>>>"
    h = raw.select(F.explode(F.array(F.from_json("header", light))).alias("h"))
    each = h.select(hex_to_long("h.number").alias("block_number"), F.lower("h.hash").alias("block_hash"), F.explode("h.transactions").alias("t"))
    return each.select(F.lower("t.hash").alias("tx_hash"), "block_number", "block_hash")


def transactions_of(blocks: DataFrame) -> DataFrame:
    """One row per transaction of native blocks, with the block's own columns."""
    return blocks.select("number", "hash", "block_ts", "miner", "author", "base_fee", F.explode("transactions").alias("t")).select("number", "hash", "block_ts", "miner", "author", "base_fee", "t.*")


def transaction_by_hash(index: DataFrame, canonical: DataFrame, raw: DataFrame, tag: int, tx_hash: str) -> DataFrame:
    """A transaction as the canonical chain holds it now: the index names its blocks, those that were reorganised away drop out.

    ``raw``: raw blocks with their ``height``.  The index's answer, a few heights, is looked
    up first; blocks and the chain are read at these heights only, and only they are parsed.
    """
    found = [(r["number"], r["hash"]) for r in index.where((F.col("tag") == tag) & (F.col("tx_hash") == tx_hash)).select(F.col("block_number").alias("number"), F.col("block_hash").alias("hash")).distinct().collect()]
    heights = sorted({n for n, _ in found if n is not None})
    named = raw.sparkSession.createDataFrame(found, "number bigint, hash string")
    chain = canonical.where(F.col("height").isin(heights)).select(F.col("height").alias("number"), "hash")
    real = F.broadcast(named.join(chain, ["number", "hash"], "left_semi"))  # as few as the heights
    return transactions_of(evm_blocks(raw.where(F.col("height").isin(heights))).join(real, ["number", "hash"], "left_semi")).where(F.col("tx_hash") == tx_hash)


def logs_of(blocks: DataFrame) -> DataFrame:
    """One row per log of native blocks."""
    each = transactions_of(blocks).select("number", "tx_hash", F.explode("logs").alias("l"))
    return each.select("number", "tx_hash", "l.*")


def traces_of(blocks: DataFrame) -> DataFrame:
    """One row per trace of native blocks, with its id."""
    each = transactions_of(blocks).select("number", "tx_hash", F.posexplode("traces").alias("position", "c"))
    return each.select("number", "tx_hash", "position", "c.*", trace_id(F.col("c.trace_type"), F.col("tx_hash"), F.col("c.trace_address")).alias("trace_id"))


def comparable_traces(traces: DataFrame) -> DataFrame:
    """Traces as they may be compared: no data in three spellings, gas left out, and a delegate call's value, which moves nothing.

    Columns input, output, gas, gas_used, type and value, as far as they are there.
    """
    out = traces.drop("gas", "gas_used")
    for c in ("input", "output"):
        if c in out.columns:
            out = out.withColumn(c, F.when(F.col(c).isin("", "0x", "0x0"), "").otherwise(F.col(c)))
    return out.withColumn("value", F.when(F.col("type") != "DELEGATECALL", F.col("value")))


# ----------------------------------------------------------------- fetched parts


def chosen_traces(txs: DataFrame, block_traces: DataFrame, single_traces: DataFrame, limits: DataFrame, best_effort: bool = False, threshold: int = 1_000_000) -> DataFrame:
    """(number, position, trace, source) of every transaction, by the rules of ingestion.

    ``txs``: number, position, tx_hash.  ``block_traces``: number, position, trace, a call
    per block.  ``single_traces``: tx_hash, trace, n_ops, a call per transaction.
    ``limits``: (low, high) ranges of heights whose blocks are traced one transaction at a
    time, as are all with ``best_effort``.  There, what has no answer, or more than
    ``threshold`` operations, gets a placeholder, and ``source`` says ignored.
    """
    if limits.limit(10_001).count() > 10_000:
        raise ValueError("more than 10000 ranges of heights")
    split = lambda how: txs.join(F.broadcast(limits), F.col("number").between(F.col("low"), F.col("high")), how)  # noqa: E731 - both ways against the ranges, without a shuffle
    alone, rest = (txs, txs.where(F.lit(False))) if best_effort else (split("left_semi"), split("left_anti"))
    whole = rest.join(block_traces, ["number", "position"], "left").select("number", "position", "trace", F.when(F.col("trace").isNull(), "missing").otherwise("block").alias("source"))
    one = alone.join(single_traces, "tx_hash", "left").withColumn("bad", F.col("trace").isNull() | (F.coalesce("n_ops", F.lit(0)) > threshold))
    placeholder = F.lit('{"type": "CALL", "error": "ignored"}')
    single = one.select("number", "position", F.when(F.col("bad"), placeholder).otherwise(F.col("trace")).alias("trace"), F.when(F.col("bad"), "ignored").otherwise("transaction").alias("source"))
    return whole.unionByName(single)


def ignored_messages(chosen: DataFrame) -> DataFrame:
    """One message per block whose traces were ignored in part: (number, positions), for the queue of failures."""
    return chosen.where("source = 'ignored'").groupBy("number").agg(F.sort_array(F.collect_list("position")).alias("positions"))


def with_known_failure(traces: DataFrame, failures: list[str], error: str = "execution failed") -> DataFrame:
    """Traces (tx_hash, trace, fetch_error) where a listed transaction, which nodes can't trace, gets a made-up one; others keep their error."""
    made = F.lit(f'{{"type": "CALL", "error": "{error}"}}')
    known = F.col("trace").isNull() & F.col("fetch_error").isNotNull() & F.col("tx_hash").isin(*failures)
    return traces.select("tx_hash", F.when(known, made).otherwise(F.col("trace")).alias("trace"), F.when(~known, F.col("fetch_error")).alias("fetch_error"))


def upgraded(raw: DataFrame, patches: DataFrame, chain: str, old_tag: int, new_tag: int) -> DataFrame:
    """Raw blocks of a new tag: Ethereum 0 to 1 adds uncles, 1 to 2 takes new traces (as many as before), Polygon 2 to 2 a new header.

    ``patches``: height, hash and the part.  A block without one keeps its own; traces in
    another number get ``upgrade_error`` and stay.
    """
    rules = {("ethereum", 0, 1): "uncles", ("ethereum", 1, 2): "traces", ("polygon", 2, 2): "header"}
    part = rules.get((chain, old_tag, new_tag))
    if part is None:
        raise NotImplementedError(f"no upgrade of {chain} from tag {old_tag} to {new_tag}")
    joined = raw.where(F.col("tag") == old_tag).join(patches.select("height", "hash", F.col(part).alias("_new")), ["height", "hash"], "left")
    fits = F.lit(True) if part != "traces" else F.size("_new") == F.size("traces")
    error = F.when(F.col("_new").isNotNull() & ~fits, F.format_string("%d traces instead of %d", F.size("_new"), F.size("traces"))) if part == "traces" else F.lit(None).cast("string")
    return joined.withColumn("upgrade_error", error).withColumn(part, F.when(F.col("_new").isNotNull() & fits, F.col("_new")).otherwise(F.col(part))).withColumn("tag", F.lit(new_tag)).drop("_new")


def unexpected(requested: DataFrame, fetched: DataFrame) -> DataFrame:
    """Requests (tag, height, hash or null) that were answered by nothing or by another block, and how."""
    f = fetched.select(F.col("height"), F.col("tag").alias("_tag"), F.col("hash").alias("_hash"), F.lit(True).alias("_there"))
    both = requested.join(f, "height", "left")
    reason = F.when(F.col("_there").isNull(), "missing").when(F.col("_tag") != F.col("tag"), "tag").when(F.col("hash").isNotNull() & ~F.col("hash").eqNullSafe(F.col("_hash")), "hash")
    return both.select("tag", "height", reason.alias("reason")).where("reason is not null")
