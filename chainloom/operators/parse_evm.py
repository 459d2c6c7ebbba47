"""EVM payloads (JSON of nodes) to typed, nested records.

Payloads are JSON strings in columns; they are parsed where they are used, so a query
reads only what it needs.  What doesn't parse, or lacks a required field, gets a
``parse_error`` and stays a row.
"""

from __future__ import annotations

import json
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainloom.functions.scalars import clean_address, clean_hex, hex_to_decimal, hex_to_long, to_timestamp
from chainloom.operators import reads

#: keccak("Transfer(address,address,uint256)"), the same for both token standards.
TRANSFER = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"

TRANSACTION = (
    "struct<hash string, from string, to string, gas string, gasPrice string, maxFeePerGas string, maxPriorityFeePerGas string, input string, nonce string, "
    "transactionIndex string, type string, value string, accessList array<struct<address string, storageKeys array<string>>>>"
)
HEADER = (
    "struct<number string, hash string, parentHash string, timestamp string, miner string, gasLimit string, gasUsed string, baseFeePerGas string, difficulty string, "
    "uncles array<string>, withdrawals array<struct<index string, validatorIndex string, address string, amount string>>, "
    f"transactions array<{TRANSACTION}>>"
)
RECEIPT = (
    "struct<transactionHash string, transactionIndex string, blockHash string, blockNumber string, gasUsed string, cumulativeGasUsed string, effectiveGasPrice string, status string, root string, type string, "
    "contractAddress string, l1Fee string, logs array<struct<address string, data string, logIndex string, topics array<string>, removed boolean>>>"
)


def _missing(struct: str, fields: list[str]) -> Column:
    """Names of the required fields that are null or empty."""
    gone = [F.when(F.coalesce(F.col(f"{struct}.{f}").cast("string"), F.lit("")) == "", F.lit(f)) for f in fields]
    return F.array_join(F.array_compact(F.array(*gone)), ",")


def _once(raw: DataFrame, payload: str, schema: str, name: str) -> DataFrame:
    """``raw`` with the parsed payload as a struct; behind a generator, so that no later projection parses it again."""
    return raw.select("*", F.explode(F.array(F.from_json(payload, schema))).alias(name))


def parse_headers(raw: DataFrame, payload: str = "header") -> DataFrame:
    """Headers and their transactions: ``h`` (as sent) and typed columns; ``parse_error`` null where all is well."""
    parsed = _once(raw, payload, HEADER, "h")
    gone = _missing("h", ["number", "hash", "timestamp"])
    return parsed.select(
        "*",
        hex_to_long("h.number").alias("number"),
        F.lower("h.hash").alias("hash"),
        F.lower("h.parentHash").alias("parent_hash"),
        to_timestamp(hex_to_long("h.timestamp")).alias("block_ts"),
        hex_to_long("h.gasLimit").alias("gas_limit"),
        hex_to_long("h.gasUsed").alias("gas_used"),
        hex_to_long("h.baseFeePerGas").alias("base_fee"),
        F.when(F.col("h").isNull() | (gone != ""), F.concat(F.lit("header lacks "), F.coalesce(gone, F.lit("everything")))).alias("parse_error"),
    )


def priority_fee(gas_price: Column, max_fee: Column, max_priority: Column, base_fee: Column) -> Column:
    """What the miner gets per gas: null without a base fee; signed, so an underpriced one shows as negative."""
    return F.when(base_fee.isNull(), F.lit(None)).when(max_fee.isNotNull() & max_priority.isNotNull(), F.least(max_fee - base_fee, max_priority)).otherwise(gas_price - base_fee)


def transactions(headers: DataFrame) -> DataFrame:
    """One row per transaction of parsed headers; ``position`` is its place in the block."""
    each = headers.select("number", F.col("hash").alias("block_hash"), "base_fee", F.posexplode("h.transactions").alias("position", "t"))
    price, most, tip = (hex_to_long(f"t.{c}") for c in ("gasPrice", "maxFeePerGas", "maxPriorityFeePerGas"))
    return each.select(
        "number",
        "block_hash",
        "position",
        F.lower("t.hash").alias("tx_hash"),
        F.lower("t.from").alias("from_address"),
        F.lower("t.to").alias("to_address"),
        hex_to_long("t.nonce").alias("nonce"),
        hex_to_long("t.gas").alias("gas"),
        price.alias("gas_price"),
        hex_to_decimal("t.value").alias("value"),
        F.coalesce(hex_to_long("t.type"), F.lit(0)).alias("type"),
        priority_fee(price, most, tip, F.col("base_fee")).alias("priority_fee"),
        F.size(F.coalesce("t.accessList", F.array())).alias("access_list_size"),
    )


def withdrawals(headers: DataFrame) -> DataFrame:
    """Withdrawals in gwei, with the id of the ledger transaction that they make."""
    each = headers.select("number", F.col("hash").alias("block_hash"), F.explode("h.withdrawals").alias("w"))
    index = hex_to_long("w.index")
    return each.select("number", index.alias("withdrawal_index"), hex_to_long("w.validatorIndex").alias("validator_index"), clean_address("w.address").alias("address"), hex_to_long("w.amount").alias("gwei"), F.concat_ws("_", F.lit("WITHDRAWAL"), "block_hash", index.cast("string")).alias("ledger_tx"))


def receipts(raw: DataFrame, payload: str = "receipt") -> DataFrame:
    """Typed receipts: the effective price falls back to the transaction's, old ones have a root for a status."""
    r = _once(raw, payload, RECEIPT, "r")
    status = hex_to_long("r.status")
    return r.select(
        *[c for c in raw.columns if c != payload],
        F.lower("r.transactionHash").alias("tx_hash"),
        hex_to_long("r.gasUsed").alias("gas_used"),
        hex_to_long("r.cumulativeGasUsed").alias("cumulative_gas_used"),
        hex_to_long("r.effectiveGasPrice").alias("effective_gas_price"),
        F.when(status.isNotNull(), status == 1).otherwise(F.when(F.col("r.root").isNotNull(), F.lit(None).cast("boolean"))).alias("succeeded"),
        hex_to_long("r.l1Fee").alias("l1_fee"),
        F.col("r.logs").alias("logs"),
        F.when(_missing("r", ["transactionHash", "gasUsed"]) != "", F.concat(F.lit("receipt lacks "), _missing("r", ["transactionHash", "gasUsed"]))).alias("parse_error"),
    )


def match_receipts(txs: DataFrame, found: DataFrame) -> DataFrame:
    """Transactions with their receipts; ``mismatch`` where there is none, or the fields they share differ."""
    r = found.select(F.col("tx_hash").alias("_hash"), F.col("gas_used").alias("receipt_gas_used"), F.col("effective_gas_price").alias("_price"), "succeeded")
    joined = txs.join(r, F.col("tx_hash") == F.col("_hash"), "left")
    return joined.withColumn("effective_gas_price", F.coalesce("_price", "gas_price")).withColumn("mismatch", F.col("_hash").isNull() | (F.col("receipt_gas_used") > F.col("gas"))).drop("_hash", "_price")


#: What token transfers need of a receipt.
LOGS = "struct<transactionHash string, logs array<struct<address string, data string, logIndex string, topics array<string>>>>"


def receipt_logs(raw: DataFrame, payload: str = "receipt") -> DataFrame:
    """(tx_hash, logs) of receipts, with nothing else of them parsed."""
    r = _once(raw, payload, LOGS, "r")
    return r.select(*[c for c in raw.columns if c != payload], F.lower("r.transactionHash").alias("tx_hash"), F.col("r.logs").alias("logs"))


def token_transfers(found: DataFrame) -> DataFrame:
    """ERC-20 (three topics, the value in the data) and ERC-721 (four topics) transfers of receipts' logs.

    Values above 256 bits and broken ids drop out.
    """
    moves = F.filter("logs", lambda x: F.size(x["topics"]).isin(3, 4) & (F.lower(F.get(x["topics"], F.lit(0))) == TRANSFER))
    logs = found.select("tx_hash", F.explode(moves).alias("l"))
    erc20 = F.size("l.topics") == 3
    logs = logs.select("tx_hash", "l", erc20.alias("erc20"), F.when(erc20, F.col("l.data")).otherwise(F.get("l.topics", F.lit(3))).alias("word"))
    good = F.col("word").rlike("^0x0*[0-9a-fA-F]{0,64}$") & (F.col("erc20") | (F.length("word") == 66))
    return logs.where(good).select(
        "tx_hash",
        hex_to_long("l.logIndex").alias("log_index"),
        F.lower("l.address").alias("token"),
        clean_address(F.col("l.topics")[1]).alias("from_address"),
        clean_address(F.col("l.topics")[2]).alias("to_address"),
        F.when(F.col("erc20"), "ERC20").otherwise("ERC721").alias("standard"),
        F.lower(F.lpad(F.right(F.substr("word", F.lit(3)), F.lit(64)), 64, "0")).alias("value_hex"),
    )


# --------------------------------------------------------------------- traces

_CALLS = {"CALL", "CALLCODE", "DELEGATECALL", "STATICCALL"}
FLAT = T.ArrayType(
    T.StructType(
        [
            T.StructField("trace_address", T.ArrayType(T.IntegerType())),
            T.StructField("type", T.StringType()),
            T.StructField("trace_type", T.StringType()),
            T.StructField("call_type", T.StringType()),
            T.StructField("from_address", T.StringType()),
            T.StructField("to_address", T.StringType()),
            T.StructField("value", T.StringType()),
            T.StructField("subtraces", T.IntegerType()),
            T.StructField("error", T.StringType()),
            T.StructField("status", T.IntegerType()),
        ]
    )
)


_ARROW = [("trace_address", pa.list_(pa.int32())), *[(k, pa.string()) for k in ("type", "trace_type", "call_type", "from_address", "to_address", "value")], ("subtraces", pa.int32()), ("error", pa.string()), ("status", pa.int32())]


def _walk(call: dict, out: list[list]) -> None:
    """Append the calls of a tree to columns, parents first; an error is inherited by what has none."""
    places, depths, types, traces, calls, senders, receivers, values, subtraces, errors, status = out
    stack = [(call, [], None)]
    while stack:
        c, at, error = stack.pop()
        get = c.get
        error = get("error") or error
        kind = get("type", "")
        below = get("calls") or ()
        is_call = kind in _CALLS
        sender, receiver, value = get("from"), get("to"), get("value")
        places += at
        depths.append(len(at))
        types.append(kind)
        traces.append("CALL" if is_call else kind)
        calls.append(kind if is_call else None)
        senders.append(sender.lower() if sender else None)
        receivers.append(receiver.lower() if receiver else None)
        values.append(str(int(value, 16)) if value else "0")
        subtraces.append(len(below))
        errors.append(error)
        status.append(0 if error else 1)
        for i in range(len(below) - 1, -1, -1):
            stack.append((below[i], [*at, i], error))


#: Parses a text from its first sign on, without the searches for white space around it.
_scan = json.JSONDecoder().scan_once


def _parsed(text: str):
    try:
        found, end = _scan(text, 0)
        if end == len(text):
            return found
    except StopIteration:
        pass
    return json.loads(text)


def _flattened(texts: list[str | None]) -> tuple[list[int], list[bool], pa.StructArray]:
    """Where each tree's calls end, which aren't trees, and the calls of all.

    Places are kept as their numbers in turn and their lengths: many lists that stay would
    be visited by Python's collector again and again.
    """
    out: list[list] = [[] for _ in range(len(_ARROW) + 1)]
    ends, bad = [0], []
    for x in texts:
        sizes = [len(c) for c in out]
        try:
            if x is not None:
                _walk(_parsed(x), out)
            bad.append(x is None)
        except (ValueError, AttributeError, TypeError):
            for c, size in zip(out, sizes):
                del c[size:]
            bad.append(True)
        ends.append(len(out[1]))
    address = pa.ListArray.from_arrays(pa.array([0, *accumulate(out[1])], pa.int32()), pa.array(out[0], pa.int32()))
    return ends, bad, pa.StructArray.from_arrays([address, *[pa.array(c, kind) for c, (_, kind) in zip(out[2:], _ARROW[1:])]], [n for n, _ in _ARROW])


@F.arrow_udf(returnType=FLAT)
def flatten_call(column: pa.Array) -> pa.Array:
    """A call tree as a list in depth-first order; no recursion in a schema is needed.  Null where it isn't JSON."""
    ends, bad, rows = _flattened(column.to_pylist())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows, mask=pa.array(bad))


@F.arrow_udf(returnType=T.ArrayType(FLAT))
def flatten_calls(column: pa.Array) -> pa.Array:
    """A list of call trees, each as a flat list."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    trees = column.flatten()
    flat = flatten_call.func(trees) if len(trees) else pa.array([], pa.list_(pa.struct(_ARROW)))
    sizes = [0 if n is None else n for n in pc.list_value_length(column).to_pylist()]
    ends = pa.array([0, *accumulate(sizes)], pa.int32())
    return pa.ListArray.from_arrays(ends, flat, mask=column.is_null())


def trace_id(kind: Column, tx_hash: Column, address: Column) -> Column:
    return F.concat_ws("_", F.lower(kind), tx_hash, F.nullif(F.array_join(address.cast("array<string>"), "_"), F.lit("")))


def flat_traces(raw: DataFrame, payload: str = "trace") -> DataFrame:
    """One row per call of each transaction's tree, in its order."""

    def rows(batches):
        for batch in batches:
            ends, _, calls = _flattened(batch.column(1).to_pylist())
            ends = np.array(ends)
            n = np.diff(ends)
            each = pa.array(np.repeat(np.arange(len(n)), n))
            position = pa.array((np.arange(ends[-1]) - np.repeat(ends[:-1], n)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(each), position, *calls.flatten()], ["tx_hash", "position", *[k for k, _ in _ARROW]])

    # calls leave Python as rows: a list of structs for each tree would be taken apart again
    kind = T.StructType([T.StructField("tx_hash", raw.schema["tx_hash"].dataType), T.StructField("position", T.IntegerType()), *FLAT.elementType.fields])
    each = raw.select("tx_hash", F.col(payload)).mapInArrow(rows, kind)
    return each.select("*", trace_id(F.col("trace_type"), F.col("tx_hash"), F.col("trace_address")).alias("trace_id"))


def parity_errors(traces: DataFrame) -> DataFrame:
    """Flat traces (tx_hash, trace_address, error) with the error of the nearest caller that has one.

    A transaction's traces are gathered, by one shuffle, in whatever order they come, and
    each looks for its callers among those of them that have an error.
    """
    own = traces.where(F.col("tx_hash").isNotNull() & F.col("trace_address").isNotNull()).groupBy("tx_hash").agg(F.collect_list(F.struct(*[c for c in traces.columns if c != "tx_hash"])).alias("_own"))
    bad = F.filter("_own", lambda y: y["error"].isNotNull())
    own = own.select("tx_hash", F.explode(F.array(F.struct(F.col("_own").alias("own"), bad.alias("bad")))).alias("_b"))

    def nearest(x):
        above = F.filter("_b.bad", lambda y: (F.size(y["trace_address"]) <= F.size(x["trace_address"])) & (F.slice(x["trace_address"], F.lit(1), F.size(y["trace_address"])) == y["trace_address"]))
        return F.array_max(F.transform(above, lambda y: F.struct(F.size(y["trace_address"]).alias("n"), y["error"].alias("error"))))["error"]

    met = F.transform("_b.own", lambda x: F.struct(x.alias("t"), F.when(F.size("_b.bad") > 0, nearest(x)).alias("inherited")))
    each = own.select("tx_hash", F.explode(met).alias("_m")).select("tx_hash", "_m.t.*", "_m.inherited")
    return each.select(*traces.columns, "inherited", F.when(F.col("inherited").isNull(), 1).otherwise(0).alias("status"))


def without_known_duplicates(txs: DataFrame, known: DataFrame) -> DataFrame:
    """Transactions without those of a list (number, position) of duplicates that nodes are known to send."""
    return reads.by_keys(txs, known, ["number", "position"], how="left_anti")


def effective_traces(found: DataFrame, txs: DataFrame, ignored: str = "ignored") -> DataFrame:
    """Every transaction with its trace, or a placeholder that says it has none; for best-effort ingestion."""
    joined = txs.select("tx_hash", "position").join(found, "tx_hash", "left")
    placeholder = F.lit(json.dumps({"type": "CALL", "error": ignored}))
    return joined.select("tx_hash", "position", F.coalesce("trace", placeholder).alias("trace"), F.col("trace").isNull().alias("ignored"))
