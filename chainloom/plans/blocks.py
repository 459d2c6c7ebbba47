"""Queries of native and ledger blocks over the test tables, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.operators import ledger_blocks, native, parse_evm, parse_other
from chainloom.plans.registry import query
from chainloom.sources.derived import spread, table


def _hex(c):
    return F.concat(F.lit("0x"), F.lower(F.hex(c)))


def _text_of(prefix, *parts):
    return F.concat(F.lit(prefix), F.concat_ws("-", *[p.cast("string") for p in parts]))


def _text(prefix, *parts):
    return _text_of(prefix, *[F.col(p) for p in parts])


def _pad(c):
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(c)), 64, "0"))


_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _key_of(r):
    """The key of a line among its order's."""
    return F.col("l_orderkey"), r["l_linenumber"], r["l_partkey"], r["l_suppkey"]


def evm_raw_blocks(spark, d) -> DataFrame:
    """An order is a block, its lines are transactions; some lack a receipt, or have one of another transaction.

    Lines are gathered as the few numbers that their JSON is made of, so the shuffle carries no payloads.
    """
    line = table(spark, d, "lineitem").select(*_KEY, (~F.coalesce(F.col("l_returnflag") == "R", F.lit(False))).alias("good"))
    rows = spread(line, "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "good"))).alias("rows"))
    name = lambda r: F.concat(F.lit("0x"), F.md5(_text_of("", *_key_of(r))))

    def tx(r):
        even = r["l_linenumber"] % 2 == 0
        return F.struct(
            name(r).alias("hash"),
            _text_of("0xA", r["l_partkey"]).alias("from"),
            _text_of("0xB", r["l_suppkey"]).alias("to"),
            _hex(r["l_partkey"]).alias("nonce"),
            _hex(F.lit(90000) + r["l_partkey"]).alias("gas"),
            _hex(F.lit(100) + r["l_suppkey"]).alias("gasPrice"),
            F.when(even, _hex(F.lit(90) + r["l_suppkey"])).alias("maxFeePerGas"),
            F.when(even, _hex(r["l_partkey"] % 9)).alias("maxPriorityFeePerGas"),
            F.when(even, "0x2").alias("type"),
            _hex(r["l_partkey"]).alias("value"),
        )

    def receipt(r):
        log = F.struct(F.lit("0xTOKEN").alias("address"), _pad(F.col("l_orderkey") + 7).alias("data"), _hex(r["l_linenumber"]).alias("logIndex"), F.array(F.lit(parse_evm.TRANSFER), _pad(r["l_partkey"]), _pad(r["l_suppkey"])).alias("topics"))
        return F.to_json(
            F.struct(
                F.when(F.col("l_orderkey") % 40 == 11, "0xother").otherwise(name(r)).alias("transactionHash"),
                _hex(F.lit(21000) + r["l_suppkey"]).alias("gasUsed"),
                _hex(r["l_partkey"] + 1).alias("effectiveGasPrice"),
                F.when(r["good"], "0x1").otherwise("0x0").alias("status"),
                F.when(r["l_linenumber"] % 3 == 0, F.array(log)).otherwise(F.array()).alias("logs"),
            )
        )

    def trace(r):
        bad = F.when(~r["good"], "reverted")
        inner = F.array(F.struct(F.lit("DELEGATECALL").alias("type"), F.lit("0x9").alias("value"), bad.alias("error"), _text_of("0xC", r["l_partkey"]).alias("from"), _text_of("0xD", r["l_suppkey"]).alias("to")), F.struct(F.lit("CREATE").alias("type"), _hex(r["l_suppkey"]).alias("value"), bad.alias("error"), _text_of("0xE", r["l_partkey"]).alias("from"), _text_of("0xF", r["l_suppkey"]).alias("to")))
        return F.to_json(F.struct(F.lit("CALL").alias("type"), _hex(r["l_partkey"] % 5).alias("value"), _text_of("0xA", r["l_partkey"]).alias("from"), _text_of("0xB", r["l_suppkey"]).alias("to"), inner.alias("calls")))

    o = table(spark, d, "orders").join(rows, F.col("o_orderkey") == F.col("l_orderkey"))
    header = F.struct(
        _hex(F.col("o_orderkey")).alias("number"),
        F.concat(F.lit("0x"), F.md5(F.col("o_orderkey").cast("string"))).alias("hash"),
        F.lit("0xP").alias("parentHash"),
        _hex(F.unix_timestamp("o_orderdate")).alias("timestamp"),
        _text("0xM", "o_custkey").alias("miner"),
        F.when(F.col("o_orderkey") % 3 != 0, _hex(F.col("o_custkey") % 50)).alias("baseFeePerGas"),
        F.transform("rows", tx).alias("transactions"),
        F.array(F.struct(_hex(F.col("o_orderkey")).alias("index"), _text("0xW", "o_custkey").alias("address"), _hex(F.col("o_custkey")).alias("amount"))).alias("withdrawals"),
    )
    got = F.when(F.col("o_orderkey") % 40 == 7, F.slice("rows", 1, F.size("rows") - 1)).otherwise(F.col("rows"))
    return o.select(
        F.col("o_orderkey").alias("height"),
        F.to_json(header).alias("header"),
        F.transform(got, receipt).alias("receipts"),
        F.transform("rows", trace).alias("traces"),
        F.array(F.to_json(F.struct(_hex(F.col("o_orderkey") - 1).alias("number"), F.lit("0xUNCLE").alias("hash"), _text("0xU", "o_custkey").alias("miner")))).alias("uncles"),
        _text("0xAuthor", "o_custkey").alias("author"),
    )


_TX = """WITH tx AS (SELECT *, '0x' || md5(l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey) AS tx_hash, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS position, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""


@query(
    _TX
    + "SELECT l_orderkey AS number, '0x' || md5(CAST(l_orderkey AS VARCHAR)) AS hash, '0xm' || o_custkey AS miner, count(*) AS n_transactions, count(*) FILTER (WHERE l_linenumber % 3 = 0 AND NOT (l_orderkey % 40 = 7 AND position = n - 1)) AS n_transfers, 3 * count(*) AS n_traces, CASE WHEN o_orderkey > 0 THEN o_orderkey - 1 END AS uncle_height, CASE WHEN l_orderkey % 40 = 7 THEN CASE WHEN n > 1 THEN (n - 1) || ' receipts of ' || n || ' transactions' END WHEN l_orderkey % 40 = 11 THEN 'receipt of another transaction at 0' END AS parse_error FROM tx GROUP BY l_orderkey, o_custkey, n, o_orderkey",
    plain=True,
)
def x2_native_blocks(spark, d):
    b = native.evm_blocks(evm_raw_blocks(spark, d), fields=["token_transfers", "traces"])
    total = lambda c: F.aggregate("transactions", F.lit(0).cast("bigint"), lambda a, t: a + F.size(t[c]))
    return b.select("number", "hash", "miner", F.col("n_transactions").cast("bigint").alias("n_transactions"), total("token_transfers").alias("n_transfers"), total("traces").alias("n_traces"), F.get("uncles", F.lit(0))["height"].alias("uncle_height"), "parse_error")


@query(_TX + "SELECT l_orderkey AS number, tx_hash, l_linenumber AS log_index, '0xtoken' AS address, '0x' || right(repeat('0', 64) || lower(to_hex(l_orderkey + 7)), 64) AS data FROM tx WHERE l_linenumber % 3 = 0 AND NOT (l_orderkey % 40 = 7 AND position = n - 1)", plain=True)
def x5_logs(spark, d):
    return native.logs_of(native.evm_blocks(evm_raw_blocks(spark, d), fields=["tx_hash", "logs"])).select("number", "tx_hash", "log_index", "address", "data")


@query(_TX + "SELECT l_orderkey AS number, tx_hash, position, '0xa' || l_partkey AS from_address, 21000 + l_suppkey AS gas_used, l_partkey + 1 AS effective_gas_price FROM tx WHERE tx_hash = (SELECT min(tx_hash) FROM tx WHERE l_orderkey % 40 <> 7)", plain=True)
def q9_native_transaction(spark, d):
    from chainloom.operators import reads
    from chainloom.sources import derived

    raw = evm_raw_blocks(spark, d)
    index = native.index_of(raw).withColumn("tag", F.lit(1))
    stale = index.withColumn("block_hash", F.explode(F.array("block_hash", F.lit("0xgone"))))
    first = index.where("block_number % 40 != 7").agg(F.min("tx_hash")).first()[0]
    canonical = reads.canonical_blocks(derived.block_writes(spark, d)).select("height", F.concat(F.lit("0x"), F.md5(F.col("height").cast("string"))).alias("hash"))
    return native.transaction_by_hash(stale, canonical, raw, 1, first).select("number", "tx_hash", "position", "from_address", "gas_used", "effective_gas_price")


_FEES = "CAST(21000 + l_suppkey AS HUGEINT) * CASE WHEN l_linenumber % 2 = 0 THEN l_partkey + 1 ELSE 100 + l_suppkey END AS fee, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(21000 + l_suppkey AS HUGEINT) * (o_custkey % 50) END AS burnt"
_GOOD = "NOT (l_orderkey % 40 = 7 AND position = n - 1)"


@query(
    _TX
    + f", t AS (SELECT *, {_FEES} FROM tx), ops AS (SELECT l_orderkey AS number, position, tx_hash, 0 AS k, 'FEE' AS type, 'SUCCESS' AS status, '0xa' || l_partkey AS account, -(fee - coalesce(burnt, 0)) AS amount FROM t WHERE {_GOOD} UNION ALL SELECT l_orderkey, position, tx_hash, 1, 'FEE', 'SUCCESS', '0xm' || o_custkey, fee - coalesce(burnt, 0) FROM t WHERE {_GOOD} UNION ALL SELECT l_orderkey, position, tx_hash, 2, 'FEE', 'SUCCESS', '0xa' || l_partkey, -burnt FROM t WHERE burnt IS NOT NULL AND {_GOOD} "
    "UNION ALL SELECT l_orderkey, position, tx_hash, 3 + side, 'CALL', 'SUCCESS', CASE side WHEN 0 THEN '0xa' || l_partkey ELSE '0xb' || l_suppkey END, (2 * side - 1) * (l_partkey % 5) FROM t, (SELECT unnest([0, 1]) AS side) WHERE l_partkey % 5 <> 0 "
    "UNION ALL SELECT l_orderkey, position, tx_hash, 5 + side, 'CREATE', CASE WHEN l_returnflag = 'R' THEN 'FAILURE' ELSE 'SUCCESS' END, CASE side WHEN 0 THEN '0xe' || l_partkey ELSE '0xf' || l_suppkey END, (2 * side - 1) * l_suppkey FROM t, (SELECT unnest([0, 1]) AS side)) "
    "SELECT number, tx_hash, CAST(row_number() OVER (PARTITION BY number, position ORDER BY k) - 1 AS INTEGER) AS op_index, type, status, account, CAST(amount AS VARCHAR) AS amount FROM ops UNION ALL SELECT o_orderkey, 'WITHDRAWAL_0x' || md5(CAST(o_orderkey AS VARCHAR)) || '_' || o_orderkey, 0, 'WITHDRAWAL', 'SUCCESS', '0xw' || o_custkey, CAST(CAST(o_custkey AS HUGEINT) * 1000000000 AS VARCHAR) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)",
    plain=True,
)
def l1_evm_ledger(spark, d):
    ops = ledger_blocks.evm_ledger_blocks(native.evm_blocks(evm_raw_blocks(spark, d), fields=ledger_blocks.EVM_FIELDS))
    return ops.select("number", "tx_hash", "op_index", "type", "status", "account", F.col("amount").cast("string").alias("amount"))


def _fee_rows(spark, d) -> DataFrame:
    """Transactions of Polygon with logs of its token and bridge."""
    topic = lambda c: _pad(c)
    n, log = F.col("l_linenumber") % 5, lambda address, topics, data: F.struct(F.lit(0).cast("bigint").alias("log_index"), F.lit(address).alias("address"), F.array(*topics).alias("topics"), data.alias("data"))
    two = F.concat(_pad(F.col("l_partkey")), F.substr(_pad(F.col("l_suppkey")), F.lit(3)))
    four = F.concat(two, F.substr(two, F.lit(3)))
    moved = log(ledger_blocks.NATIVE_TOKEN, [F.lit(ledger_blocks.LOG_TRANSFER), F.lit(ledger_blocks.NATIVE_TOPIC), topic(F.col("l_partkey")), topic(F.col("l_suppkey"))], two)
    swap = log(ledger_blocks.HOP_SWAP, [F.lit(ledger_blocks.HOP_SWAPPED), topic(F.col("l_partkey"))], four)
    done = log(ledger_blocks.HOP_BRIDGE, [F.lit(ledger_blocks.HOP_COMPLETED), topic(F.col("l_suppkey"))], two)
    deposit = log("0xany", [F.lit(ledger_blocks.TOKEN_DEPOSITED), topic(F.lit(1)), F.lit(ledger_blocks.NATIVE_TOPIC), topic(F.col("l_suppkey"))], two)
    nobody = F.lit(native.NULL_ADDRESS)
    block_hash = F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("l_orderkey")), 64, "0"))
    logs = F.when(n == 0, F.array(moved)).when(n == 1, F.array(swap, done)).when(n == 2, F.array(swap)).when(n == 3, F.array(deposit)).otherwise(F.array(moved))
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("number"),
        block_hash.alias("hash"),
        F.when(n == 3, ledger_blocks.bor_hash("l_orderkey", block_hash)).otherwise(F.md5(_text("", *_KEY))).alias("tx_hash"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.lit("author").alias("author"),
        (F.col("l_suppkey") % 3).alias("base_fee"),
        F.when(n == 0, nobody).otherwise(_text("f", "l_partkey")).alias("from_address"),
        F.when(n == 0, nobody).otherwise(_text("t", "l_partkey")).alias("to_address"),
        F.lit(0).alias("type"),
        F.when(n == 0, 0).otherwise(F.col("l_partkey") + 1).cast("bigint").alias("gas_used"),
        F.lit(7).cast("bigint").alias("gas_price"),
        F.lit(7).cast("bigint").alias("effective_gas_price"),
        F.lit(True).alias("succeeded"),
        logs.alias("logs"),
        F.lit(None).cast("array<struct<log_index bigint, token string, from_address string, to_address string, standard string, value_hex string>>").alias("token_transfers"),
        F.lit(None).cast(parse_evm.FLAT).alias("traces"),
    )


_ADDRESS = "'0x' || right(repeat('0', 40) || lower(to_hex({c})), 40)"
_P, _S = _ADDRESS.format(c="l_partkey"), _ADDRESS.format(c="l_suppkey")


@query(
    f"SELECT l_orderkey AS number, l_linenumber % 5 AS n, l_linenumber, l_partkey, l_suppkey, k AS op_index, type, account, CAST(amount AS BIGINT) AS amount FROM (SELECT *, unnest(CASE l_linenumber % 5 WHEN 0 THEN [0, 1] WHEN 1 THEN [0, 1, 2, 3, 4] WHEN 3 THEN [0, 1, 2, 3, 4] ELSE [0, 1, 2, 3] END) AS k, unnest(CASE l_linenumber % 5 WHEN 0 THEN ['CALL', 'CALL'] WHEN 1 THEN ['FEE', 'FEE', 'FEE', 'FEE', 'PAYMENT'] WHEN 3 THEN ['FEE', 'FEE', 'FEE', 'FEE', 'PAYMENT'] ELSE ['FEE', 'FEE', 'FEE', 'FEE'] END) AS type, "
    f"unnest(CASE l_linenumber % 5 WHEN 0 THEN [{_P}, {_S}] WHEN 2 THEN ['f' || l_partkey, 'author', 'f' || l_partkey, '0x70bca57f4579f58670ab2d18ef16e02c17553c38'] WHEN 4 THEN ['f' || l_partkey, 'author', 'f' || l_partkey, '0x70bca57f4579f58670ab2d18ef16e02c17553c38'] ELSE ['f' || l_partkey, 'author', 'f' || l_partkey, '0x70bca57f4579f58670ab2d18ef16e02c17553c38', {_S}] END) AS account, "
    "unnest(CASE l_linenumber % 5 WHEN 0 THEN [-l_partkey, l_partkey] WHEN 1 THEN [-e, e, -b, b, l_suppkey] WHEN 3 THEN [-e, e, -b, b, l_partkey] ELSE [-e, e, -b, b] END) AS amount FROM (SELECT *, (l_partkey + 1) * (l_suppkey % 3) AS b, (l_partkey + 1) * (7 - l_suppkey % 3) AS e FROM lineitem))",
    plain=True,
)
def l8_l10_polygon_ledger(spark, d):
    """Fees, log transfers, bridge payments and state-sync deposits of Polygon."""
    rows = _fee_rows(spark, d)
    polygon = rows.withColumn("_sync", F.col("tx_hash") == ledger_blocks.bor_hash("number", "hash"))
    parts = [ledger_blocks.evm_fee("polygon", F.col("author")), ledger_blocks.evm_token_ops(), ledger_blocks.evm_trace_ops(), ledger_blocks.polygon_log_transfers(), ledger_blocks.polygon_bridge(), ledger_blocks.polygon_deposits(F.col("_sync"))]
    ops = F.concat(*[F.coalesce(p, F.array().cast(ledger_blocks._NONE)) for p in parts])
    each = ledger_blocks.numbered(polygon, ops, F.col("number"), (F.col("l_linenumber") % 5).alias("n"), *[F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey")])
    return each.select("number", "n", "l_linenumber", "l_partkey", "l_suppkey", "op_index", "o.type", "o.account", F.col("o.amount").cast("bigint").alias("amount"))


def solana_raw_blocks(spark, d) -> DataFrame:
    """An order is a slot, its lines are transactions: fee and transfer, or a program that isn't known and moves a token.

    Lines are gathered as the few numbers that their JSON is made of, so the shuffle carries no payloads.
    """
    line = table(spark, d, "lineitem").select(*_KEY, F.col("l_quantity").cast("bigint").alias("q"))
    rows = spread(line, "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "q"))).alias("rows"))
    token = lambda amount: F.array(F.struct(F.lit(1).alias("accountIndex"), F.lit("mint").alias("mint"), F.lit("owner").alias("owner"), F.struct(amount.cast("string").alias("amount")).alias("uiTokenAmount")))
    vote = F.to_json(F.struct(F.lit("vote").alias("program"), F.struct(F.lit("vote").alias("type")).alias("parsed")))
    odd = F.to_json(F.struct(F.lit("mystery").alias("program")))

    def tx(r):
        n, q = r["l_linenumber"] % 3, r["q"]
        transfer = F.to_json(F.struct(F.lit("system").alias("program"), F.struct(F.lit("transfer").alias("type"), F.struct(F.lit("payer").alias("source"), F.lit("other").alias("destination"), q.alias("lamports")).alias("info")).alias("parsed")))
        instruction = F.when(n == 0, odd).when(n == 1, transfer).otherwise(vote)
        moved = F.when(n == 2, F.lit(0)).otherwise(q)
        pre = [F.lit(1000000) + r["l_partkey"], r["l_suppkey"]]
        return F.struct(
            F.struct(F.array(F.md5(_text_of("", *_key_of(r)))).alias("signatures"), F.struct(F.array(F.struct(F.lit("payer").alias("pubkey")), F.struct(F.lit("other").alias("pubkey"))).alias("accountKeys"), F.array(instruction).alias("instructions")).alias("message")).alias("transaction"),
            F.struct(
                F.lit(5).alias("fee"),
                F.array(*[x.cast("bigint") for x in pre]).alias("preBalances"),
                F.array((pre[0] - 5 - moved).cast("bigint"), (pre[1] + moved + F.when(F.col("l_orderkey") % 50 == 3, 1).otherwise(0)).cast("bigint")).alias("postBalances"),
                F.when(n == 0, token(r["l_partkey"])).alias("preTokenBalances"),
                F.when(n == 0, token(r["l_partkey"] + r["l_suppkey"])).alias("postTokenBalances"),
            ).alias("meta"),
        )

    block = F.struct(F.md5(F.col("l_orderkey").cast("string")).alias("blockhash"), (F.col("l_orderkey") - 1).alias("parentSlot"), F.lit(1600000000).alias("blockTime"), F.array(F.struct(F.lit("validator").alias("pubkey"), (F.col("l_orderkey") % 4 - 1).alias("lamports"))).alias("rewards"), F.transform("rows", tx).alias("transactions"))
    skipped = F.col("l_orderkey") % 17 == 5
    # the instructions are JSON in JSON, as text that the block's schema reads
    return rows.select(F.col("l_orderkey").alias("slot"), F.when(F.col("l_orderkey") % 29 == 2, 1).otherwise(2).alias("tag"), skipped.alias("skipped"), F.when(~skipped, F.to_json(block)).alias("payload"))


@query("SELECT l_orderkey AS slot, l_orderkey % 17 = 5 AS skipped, CASE WHEN l_orderkey % 17 <> 5 THEN md5(CAST(l_orderkey AS VARCHAR)) END AS hash, CASE WHEN l_orderkey % 17 <> 5 THEN count(*) END AS n_transactions, CASE WHEN l_orderkey % 29 = 2 AND l_orderkey % 17 <> 5 THEN 'not implemented' END AS parse_error FROM lineitem GROUP BY 1", plain=True)
def x15_solana_blocks(spark, d):
    b = ledger_blocks.solana_blocks(solana_raw_blocks(spark, d))
    return b.select("slot", "skipped", "hash", F.when(F.col("transactions").isNotNull(), F.size("transactions")).cast("bigint").alias("n_transactions"), "parse_error")


@query(
    "SELECT slot, tx_id, CAST(row_number() OVER (PARTITION BY slot, position ORDER BY k) - 1 AS INTEGER) AS op_index, type, account, amount, token, is_vote FROM ("
    "SELECT l_orderkey AS slot, position, md5(l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey) AS tx_id, k, CASE WHEN k = 0 THEN 'FEE' ELSE 'TRANSFER' END AS type, ['payer', 'payer', 'other', 'owner'][k + 1] AS account, [-5, -q, q + CASE WHEN l_orderkey % 50 = 3 AND l_linenumber % 3 = 0 THEN 1 ELSE 0 END, l_suppkey][k + 1] AS amount, CASE WHEN k = 3 THEN 'mint' END AS token, l_linenumber % 3 = 2 AS is_vote FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS position FROM lineitem), (SELECT unnest([0, 1, 2, 3]) AS k) WHERE l_orderkey % 17 <> 5 AND (k = 0 OR (k IN (1, 2) AND l_linenumber % 3 <> 2) OR (k = 3 AND l_linenumber % 3 = 0 AND l_suppkey <> 0)) "
    "UNION ALL SELECT DISTINCT l_orderkey, 0, md5(CAST(l_orderkey AS VARCHAR)), 0, CASE WHEN l_orderkey % 4 = 0 THEN 'FEE' ELSE 'REWARD' END, 'validator', l_orderkey % 4 - 1, NULL, FALSE FROM lineitem WHERE l_orderkey % 17 <> 5 AND l_orderkey % 4 <> 1)",
    plain=True,
)
def l12_solana_ledger(spark, d):
    ops = ledger_blocks.solana_ledger(ledger_blocks.solana_blocks(solana_raw_blocks(spark, d)))
    return ops.select("slot", "tx_id", "op_index", "type", "account", F.col("amount").cast("bigint").alias("amount"), "token", "is_vote")


@query("SELECT l_orderkey AS slot, md5(l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey) AS tx_id, 'other' AS account, CAST(NULL AS VARCHAR) AS token, 1 AS residual FROM lineitem WHERE l_orderkey % 50 = 3 AND l_orderkey % 17 <> 5 AND l_linenumber % 3 <> 0", plain=True)
def v6_solana_residuals(spark, d):
    """Accounts whose balances native instructions don't explain: in some slots a lamport too much."""
    blocks = ledger_blocks.solana_blocks(solana_raw_blocks(spark, d))
    return ledger_blocks.solana_residuals(blocks).withColumn("residual", F.col("residual").cast("bigint"))


# ------------------------------------------------------- parts that are fetched


@query("SELECT o_orderkey AS number, CASE WHEN n % 2 = 0 THEN n ELSE n - 1 END AS n_receipts, n AS n_traces, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS n_uncles FROM (SELECT o_orderkey, 1 + o_orderkey % 4 AS n FROM orders)", plain=True)
def n3_assembled_blocks(spark, d):
    """Raw blocks from four raw tables, some of whose receipts are missing."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("height"), F.md5(F.col("o_orderkey").cast("string")).alias("hash"), F.to_json(F.struct("o_orderkey")).alias("header"))
    each = o.withColumn("position", F.explode(F.sequence(F.lit(0), (F.col("height") % 4).cast("int"))))
    n = F.col("height") % 4 + 1
    receipts = each.where((n % 2 == 0) | (F.col("position") < n - 1)).select("hash", "position", F.col("position").cast("string").alias("receipt"))
    traces = each.select("hash", "position", F.col("position").cast("string").alias("trace"))
    uncles = o.where("height % 2 = 0").select("hash", F.lit(0).alias("position"), F.lit("u").alias("uncle"))
    made = native.assemble(o, receipts, traces, uncles)
    return made.select(F.col("height").alias("number"), *[F.size(c).cast("bigint").alias(f"n_{c}") for c in ("receipts", "traces", "uncles")])


@query("SELECT l_orderkey AS number, count(*) FILTER (WHERE l_orderkey NOT BETWEEN 100 AND 900) AS from_block, count(*) FILTER (WHERE l_orderkey BETWEEN 100 AND 900 AND l_linenumber % 3 <> 0) AS from_transaction, count(*) FILTER (WHERE l_orderkey BETWEEN 100 AND 900 AND l_linenumber % 3 = 0) AS ignored FROM lineitem GROUP BY 1", plain=True)
def n5_chosen_traces(spark, d):
    """Traces by block, except in a listed range of heights, where some transactions have no answer."""
    line = table(spark, d, "lineitem")
    txs = line.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("lines")).select(F.col("l_orderkey").alias("number"), F.posexplode("lines").alias("position", "line")).withColumn("tx_hash", F.concat_ws("-", "number", "position"))
    whole = txs.select("number", "position", F.lit("{}").alias("trace"))
    single = txs.where("line % 3 != 0 or number % 2 = 0").select("tx_hash", F.lit("{}").alias("trace"), F.when(F.col("line") % 3 == 0, 50).otherwise(1).alias("n_ops"))
    limits = spark.createDataFrame([(100, 900)], "low bigint, high bigint")
    found = native.chosen_traces(txs.drop("line"), whole, single, limits, threshold=10)
    count = lambda s: F.count_if(F.col("source") == s)
    return found.groupBy("number").agg(count("block").alias("from_block"), count("transaction").alias("from_transaction"), count("ignored").alias("ignored"))


@query("SELECT o_orderkey AS height, 2 AS tag, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE 'old' END AS first_trace, CASE WHEN o_orderkey % 5 = 1 THEN '3 traces instead of 2' END AS upgrade_error FROM orders", plain=True)
def n7_upgraded_traces(spark, d):
    """Blocks of a new tag take new traces if they are as many as before."""
    raw = table(spark, d, "orders").select(F.lit(1).alias("tag"), F.col("o_orderkey").alias("height"), F.md5(F.col("o_orderkey").cast("string")).alias("hash"), F.array(F.lit("old"), F.lit("b")).alias("traces"))
    new = F.when(F.col("height") % 5 == 0, F.array(F.lit("new"), F.lit("b"))).otherwise(F.array(F.lit("x"), F.lit("y"), F.lit("z")))
    patches = raw.where("height % 5 < 2").select("height", "hash", new.alias("traces"))
    return native.upgraded(raw, patches, "ethereum", 1, 2).select("height", "tag", F.get("traces", F.lit(0)).alias("first_trace"), "upgrade_error")


@query("SELECT o_orderkey AS height, CASE WHEN o_orderkey % 7 = 0 THEN 'missing' WHEN o_orderkey % 11 = 0 THEN 'tag' ELSE 'hash' END AS reason FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0", plain=True)
def n15_unexpected_blocks(spark, d):
    asked = table(spark, d, "orders").select(F.lit(1).alias("tag"), F.col("o_orderkey").alias("height"), F.md5(F.col("o_orderkey").cast("string")).alias("hash"))
    got = asked.where("height % 7 != 0").withColumn("tag", F.when(F.col("height") % 11 == 0, 2).otherwise(1)).withColumn("hash", F.when(F.col("height") % 13 == 0, "x").otherwise(F.col("hash")))
    return native.unexpected(asked, got).select("height", "reason")


@query("SELECT o_orderkey AS number, CASE WHEN o_orderkey * 20000 < 22207818 THEN 2 ELSE 1 END AS n_traces, CASE WHEN o_orderkey * 20000 < 22207818 THEN 'outer' END AS error FROM orders", plain=True)
def x9_arbitrum_traces(spark, d):
    """One flat list of traces before the upgrade, a call tree for each transaction after it."""
    o = table(spark, d, "orders").withColumn("h", F.col("o_orderkey") * 20000)
    tx = F.struct(F.lit("0xT").alias("hash"), F.lit("0xa").alias("from"), F.lit("0xb").alias("to"))
    header = F.struct(_hex(F.col("h")).alias("number"), F.lit("0xh").alias("hash"), F.lit("0x1").alias("timestamp"), F.array(tx).alias("transactions"))
    step = lambda at, error: F.struct(F.struct(F.lit("call").alias("callType"), F.lit("0x1").alias("value")).alias("action"), error.alias("error"), F.array(*[F.lit(x) for x in at]).cast("array<int>").alias("traceAddress"), F.lit("0xt").alias("transactionHash"), F.lit("call").alias("type"))
    flat = F.to_json(F.array(step([], F.lit("outer")), step([0], F.lit(None).cast("string"))))
    traces = F.array(F.when(F.col("h") < native.ARBITRUM_NITRO, flat).otherwise(F.lit('{"type": "CALL"}')))
    none = F.array().cast("array<string>")
    raw = o.select("o_orderkey", F.to_json(header).alias("header"), none.alias("receipts"), traces.alias("traces"), none.alias("uncles"), F.lit(None).cast("string").alias("author"))
    t = F.get(F.get("transactions", F.lit(0))["traces"], F.size(F.get("transactions", F.lit(0))["traces"]) - 1)
    return native.evm_blocks(raw, "arbitrum").select(F.col("o_orderkey").alias("number"), F.size(F.get("transactions", F.lit(0))["traces"]).cast("bigint").alias("n_traces"), t["error"].alias("error"))


@query("SELECT o_orderkey AS number, '0xauthor' || o_custkey AS author, CASE WHEN o_orderkey % 2 = 1 THEN '1 traces of 2 transactions' END AS parse_error FROM orders", plain=True)
def x11_polygon_blocks(spark, d):
    """Blocks whose last transaction has no trace: right if it is from nobody to nobody."""
    o = table(spark, d, "orders")
    none, nobody = F.array().cast("array<string>"), F.when(F.col("o_orderkey") % 2 == 0, native.NULL_ADDRESS).otherwise("0xa")
    tx = lambda who: F.struct(F.lit("0xT").alias("hash"), who.alias("from"), who.alias("to"))
    header = F.struct(_hex(F.col("o_orderkey") + 1).alias("number"), F.lit("0xh").alias("hash"), F.lit("0x1").alias("timestamp"), F.array(tx(F.lit("0xb")), tx(nobody)).alias("transactions"))
    raw = o.select("o_orderkey", F.to_json(header).alias("header"), none.alias("receipts"), F.array(F.lit('{"type": "CALL"}')).alias("traces"), none.alias("uncles"), _text("0xAuthor", "o_custkey").alias("author"))
    return native.evm_blocks(raw, "polygon").select(F.col("o_orderkey").alias("number"), "author", "parse_error")


@query("SELECT l_linenumber % 3 AS kind, count(*) AS n FROM lineitem WHERE l_linenumber % 3 <> 1 AND l_partkey % 2 = 1 AND NOT (l_linenumber % 3 = 2) GROUP BY 1", plain=True)
def v2_comparable_traces(spark, d):
    """Traces of two nodes that differ once what doesn't count is left out."""
    line = table(spark, d, "lineitem")
    n = F.col("l_linenumber") % 3
    kind = F.when(n == 2, "DELEGATECALL").otherwise("CALL")
    side = lambda data, value, gas: line.select(F.md5(_text("", *_KEY)).alias("id"), n.alias("kind"), kind.alias("type"), data.alias("input"), value.alias("value"), gas.alias("gas"))
    odd = F.col("l_partkey") % 2
    a = native.comparable_traces(side(F.lit("0x"), F.lit(0).cast("bigint"), F.lit(1)))
    b = native.comparable_traces(side(F.when(n == 1, F.lit("0x0")).otherwise(F.lit("")), F.when(n == 1, F.lit(0)).otherwise(odd).cast("bigint"), F.lit(2)))
    both = a.alias("a").join(b.alias("b"), "id").where(~(F.col("a.input").eqNullSafe(F.col("b.input")) & F.col("a.value").eqNullSafe(F.col("b.value"))))
    return both.groupBy(F.col("a.kind").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS height, 't' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS tx, l_linenumber = 1 AS mints FROM lineitem", plain=True)
def x12_minting_transactions(spark, d):
    from chainloom.plans.registry import bitcoin_raw

    return parse_other.bitcoin_mints(parse_other.bitcoin_blocks(bitcoin_raw(spark, d))).select("height", "tx", "mints")


# --------------------------------------------------------------------- monitors


@query("SELECT unnest(['latest_block', 'block_by_height', 'blocks_by_range', 'block_files', 'event_by_id', 'events_after', 'first_event_of_height']) AS api, unnest([1, 1, 50, 50, 1, 50, 1]) AS n, TRUE AS ok UNION ALL SELECT 'blocks_of_transactions', count(*), TRUE FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN (SELECT max(o_orderkey) FILTER (WHERE o_orderkey % 100 = 99) - 37 AS t FROM orders) ON l_orderkey BETWEEN t - 49 AND t WHERE l_orderkey % 17 <> 5)", plain=True)
def m2_polling_canary(spark, d):
    from chainloom.operators import verify
    from chainloom.sources import derived

    return verify.polling_canary(derived.block_writes(spark, d), derived.watermarks(spark, d), derived.chain_events(spark, d), derived.tx_index(spark, d), 1, 50)


@query("SELECT event_tag, event_id, event_type, height FROM all_events QUALIFY event_id > max(event_id) OVER (PARTITION BY event_tag) - 3")
def m3_streaming_canary(spark, d):
    from chainloom.operators import verify
    from chainloom.sources import derived

    both = derived.chain_events(spark, d).unionByName(derived.chain_events(spark, d, 1))
    return verify.streaming_canary(both).select("event_tag", "event_id", "event_type", "height")


@query("SELECT event_type AS method, count(*) FILTER (WHERE event_id % 5 <> 1) AS successes, count(*) FILTER (WHERE event_id % 5 = 1) AS errors, round(avg(event_id % 100), 6) AS mean_ms FROM events GROUP BY 1", plain=True)
def m6_method_counters(spark, d):
    from chainloom.operators import verify

    n = F.col("event_id") % 5
    calls = table(spark, d, "events").select(F.col("event_type").alias("method"), F.when(n == 0, "NOT_FOUND").when(n == 1, "INTERNAL").alias("error"), (F.col("event_id") % 100).alias("ms"))
    return verify.method_counters(calls, ["NOT_FOUND"]).withColumn("mean_ms", F.round("mean_ms", 6))


@query("SELECT o_orderkey % 7 AS node, o_orderkey AS chain, o_orderkey % 5 AS block_height_delta, CASE WHEN o_orderkey % 5 <= 2 THEN 'success' ELSE 'error' END AS block_height_sla, o_orderkey % 90 AS time_delta_s, CASE WHEN o_orderkey % 90 <= 60 THEN 'success' ELSE 'error' END AS time_sla FROM orders", plain=True)
def m1_node_canary(spark, d):
    from chainloom.operators import verify

    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    tips = o.select(key.alias("chain"), (key + key % 5).alias("node_height"), key.alias("stored_height"), key.alias("event_height"), F.timestamp_seconds(F.lit(1000000) + key % 90).alias("node_ts"), F.timestamp_seconds(F.lit(1000000)).alias("stored_ts"))
    return verify.canary(tips, 2, 60).select((F.col("chain") % 7).alias("node"), "chain", "block_height_delta", "block_height_sla", "time_delta_s", "time_sla")


# ----------------------------------------------------------------------- stores


def _store(spark):
    from chainloom.sources.store import Store, new_path

    return Store(spark, new_path(spark, "store"))


@query("SELECT tag, height, hash, parent_hash, skipped FROM canonical")
def w1_persisted_blocks(spark, d):
    """Canonical blocks of a store that was filled in two jobs, and in which a third was lost before its pointer moved."""
    from chainloom.operators import reads
    from chainloom.sources import derived

    store, blocks = _store(spark), reads.canonical_blocks(derived.block_writes(spark, d)).drop("write_seq")
    half = blocks.agg(F.max("height")).first()[0] // 2
    store.persist_blocks(blocks.where(F.col("height") <= half))
    before = blocks.where((F.col("height") <= half) & ~F.col("skipped")).agg(F.max(F.struct("height", "hash")).alias("b")).first()["b"]
    store.persist_blocks(blocks.where(F.col("height") > half), last_block=(before["height"], before["hash"]))
    lost = blocks.withColumn("hash", F.lit("lost")).withColumn("object_key", F.lit(None).cast("string")).withColumn("write_seq", F.lit(store.next_seq("block_meta")))
    store.append("block_meta", lost)
    return store.canonical(1).select("tag", "height", "hash", "parent_hash", "skipped")


@query("SELECT event_tag, event_id, event_type, height, hash FROM events0")
def w3_event_log(spark, d):
    """A stream that was appended to, taken back by its pointer, and written on."""
    from chainloom.sources import derived

    store, events = _store(spark), derived.chain_events(spark, d)
    half = events.agg(F.max("event_id")).first()[0] // 2
    store.add_event_entries(0, events.where(F.col("event_id") <= half))
    store.append("chain_events", events.where(F.col("event_id") > half).withColumn("hash", F.lit("lost")).withColumn("write_seq", F.lit(store.next_seq("chain_events"))))
    store.set_max_event_id(0, half // 2)
    store.add_event_entries(0, events.where(F.col("event_id") > half // 2))
    return store.events(0).select("event_tag", "event_id", "event_type", "height", "hash")


@query("SELECT height, CASE WHEN skipped THEN NULL WHEN height % 2 = 0 THEN 'new ' || hash ELSE 'old ' || hash END AS payload FROM canonical")
def r16_payloads(spark, d):
    """Payloads packed in two ways, half of them written again; skipped blocks have none."""
    from chainloom.operators import reads
    from chainloom.sources import derived

    store, blocks = _store(spark), reads.canonical_blocks(derived.block_writes(spark, d)).select("tag", "height", "hash", "skipped")
    body = lambda word: F.concat(F.lit(word), F.col("hash")).cast("binary")
    store.put_payloads(blocks.withColumn("payload", body("old ")))
    store.put_payloads(blocks.where("height % 2 = 0").withColumn("payload", body("new ")), "NONE")
    return store.payloads(blocks).select("height", F.col("payload").cast("string").alias("payload"))


@query("SELECT tag, tx_hash, block_number, block_hash FROM tx_index")
def w5_transaction_index(spark, d):
    """An index that a rerun wrote twice in part."""
    from chainloom.sources import derived

    store, packed = _store(spark), derived.packed_tx_index(spark, d)
    store.index_transactions(packed)
    store.index_transactions(packed.where("block_number % 3 = 0"))
    return store.transactions(1).select("tag", "tx_hash", "block_number", "block_hash")


@query("SELECT event_type AS topic, CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS INTEGER) AS retries, count(*) AS n FROM events WHERE event_id % 3 <> 1 GROUP BY 1, 2", plain=True)
def st10_settled_messages(spark, d):
    """Messages of a queue of failures after one round: some are done, some wait for another try, some had no turn."""
    store = _store(spark)
    sent = table(spark, d, "events").select(F.col("event_id").cast("string").alias("message_id"), F.col("event_type").alias("topic"), F.lit(0).alias("retries"), F.current_timestamp().alias("sent_ts"), F.lit("{}").alias("data"), F.lit(False).alias("deleted"), F.lit(1).cast("bigint").alias("write_seq"))
    store.append("dlq", sent)
    n = F.col("message_id").cast("bigint") % 3
    store.settle(store.messages().where(n != 0).select("message_id", (n == 1).alias("done")))
    return store.messages().groupBy("topic", "retries").agg(F.count("*").alias("n"))
