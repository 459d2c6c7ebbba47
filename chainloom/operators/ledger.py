"""Balance changes: double-entry operations, fees, rewards and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEI = 10**18
GWEI = 10**9
SATOSHI = 10**8


def account_balances(ops: DataFrame) -> DataFrame:
    """Sum of successful operations of each account."""
    return ops.where("status = 'SUCCESS'").groupBy("account").agg(F.sum("amount").alias("balance"), F.count("*").alias("n_ops"))


def reconcile(ops: DataFrame, balances: DataFrame) -> DataFrame:
    """What balances (account, pre, post) change beyond their operations; only what isn't zero."""
    sums = account_balances(ops).select("account", "balance")
    joined = balances.join(sums, "account", "left")
    implied = F.col("post") - (F.col("pre") + F.coalesce("balance", F.lit(0)))
    return joined.select("account", implied.alias("amount")).where("amount != 0")


def token_deltas(pre: DataFrame, post: DataFrame, keys: list[str]) -> DataFrame:
    """Changes of token balances: absent before, 0 before; absent after, 0 after."""
    a, b = pre.select(*keys, F.col("amount").alias("pre")), post.select(*keys, F.col("amount").alias("post"))
    both = a.join(b, keys, "full_outer")
    return both.select(*keys, (F.coalesce("post", F.lit(0)) - F.coalesce("pre", F.lit(0))).alias("amount")).where("amount != 0")


def fee_ops(tx: DataFrame) -> DataFrame:
    """Fee operations of EVM transactions: the sender pays the miner what doesn't burn, and loses what does.

    ``tx``: tx_hash, sender, miner, gas_used, effective_gas_price, base_fee (null before
    fees burned: no third operation).
    """
    burnt = F.col("gas_used") * F.col("base_fee")
    earned = F.col("gas_used") * F.col("effective_gas_price") - F.coalesce(burnt, F.lit(0))
    op = lambda i, account, amount: F.struct(F.lit(i).alias("i"), F.lit("FEE").alias("type"), account.alias("account"), amount.alias("amount"))
    pair = F.array(op(0, F.col("sender"), -earned), op(1, F.col("miner"), earned))
    ops = F.when(burnt.isNull(), pair).otherwise(F.concat(pair, F.array(op(2, F.col("sender"), -burnt))))
    return tx.select("tx_hash", F.explode(ops).alias("op")).select("tx_hash", F.col("op.i").alias("op_index"), "op.type", "op.account", "op.amount")


def block_reward(height: Column, forks: tuple[int, int, int] = (4_370_000, 7_280_000, 15_537_394)) -> Column:
    """Reward of a block in wei by fork height: 5, 3, 2 and, after the merge, 0 ether."""
    a, b, c = forks
    return F.when(height < a, F.lit(5 * WEI)).when(height < b, F.lit(3 * WEI)).when(height < c, F.lit(2 * WEI)).otherwise(F.lit(0)).cast("decimal(38,0)")


def reward_ops(blocks: DataFrame) -> DataFrame:
    """Miner and uncle rewards; ``blocks``: height, miner, uncles (array of height and miner)."""
    reward = block_reward(F.col("height"))
    miner = blocks.select("height", F.col("miner").alias("account"), (reward + F.size("uncles") * F.floor(reward / 32)).cast("decimal(38,0)").alias("amount"))
    uncle = blocks.select("height", F.explode("uncles").alias("u"), reward.alias("r")).select("height", F.col("u.miner").alias("account"), F.floor((F.col("u.height") + 8 - F.col("height")) * F.col("r") / 8).cast("decimal(38,0)").alias("amount"))
    return miner.unionByName(uncle).where("amount != 0")


def trace_ops(traces: DataFrame) -> DataFrame:
    """From each value-moving trace a pair of operations; delegate calls and call codes move nothing.

    ``traces``: tx_hash, trace_index, type, sender, receiver, value, failed.
    """
    moving = traces.where(((F.col("value") != 0) | (F.col("type") != "CALL")) & ~F.col("type").isin("CALLCODE", "DELEGATECALL"))
    status = F.when(F.col("failed"), "FAILURE").otherwise("SUCCESS")
    pair = F.array(F.struct(F.col("sender").alias("account"), (-F.col("value")).alias("amount")), F.struct(F.col("receiver").alias("account"), F.col("value").alias("amount")))
    return moving.select("tx_hash", "trace_index", "type", status.alias("status"), F.posexplode(pair).alias("side", "op")).select("tx_hash", (F.col("trace_index") * 2 + F.col("side")).alias("op_index"), "type", "status", "op.account", "op.amount")


def utxo_inputs(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Inputs with the outputs they spend (``found`` false where there is none)."""
    o = outputs.select(F.col("tx").alias("prev_tx"), F.col("n").alias("prev_n"), F.col("address").alias("prev_address"), F.col("value").alias("prev_value"))
    joined = inputs.join(o, ["prev_tx", "prev_n"], "left")
    return joined.withColumn("found", F.col("prev_value").isNotNull())


def utxo_totals(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Of each transaction: sums and counts of both sides and the fee (0 for one that mints)."""
    i = inputs.groupBy("tx").agg(F.sum("prev_value").alias("input_value"), F.count("*").alias("input_count"))
    o = outputs.groupBy("tx").agg(F.sum("value").alias("output_value"), F.count("*").alias("output_count"))
    both = o.join(i, "tx", "left")
    value = F.coalesce("input_value", F.lit(0))
    return both.select("tx", value.alias("input_value"), F.coalesce("input_count", F.lit(0)).alias("input_count"), "output_value", "output_count", F.when(value == 0, 0).otherwise(value - F.col("output_value")).alias("fee"))


def utxo_ops(inputs: DataFrame, outputs: DataFrame, skipped_tx: list[str] = ()) -> DataFrame:
    """INPUT (spent, negative) and OUTPUT operations; coins are named tx:n; an output without address is its own account and an OP_RETURN no coin."""
    status = lambda c: F.when(F.col(c).isin(*skipped_tx), "SKIPPED").otherwise("SUCCESS") if skipped_tx else F.lit("SUCCESS")
    coin_in, coin_out = F.concat_ws(":", "prev_tx", "prev_n"), F.concat_ws(":", "tx", "n")
    spent = inputs.select("tx", F.lit("INPUT").alias("type"), F.coalesce("prev_address", coin_in).alias("account"), (-F.col("prev_value")).alias("amount"), coin_in.alias("coin"), status("tx").alias("status"))
    made = outputs.select("tx", F.lit("OUTPUT").alias("type"), F.coalesce("address", coin_out).alias("account"), F.col("value").alias("amount"), F.when(F.col("address") != "OP_RETURN", coin_out).alias("coin"), status("tx").alias("status"))
    return spent.unionByName(made)


# -------------------------------------------------------- chains with rules of their own

#: Deposits into rollups pay no fee.
DEPOSIT = 126


def base_fee_ops(tx: DataFrame) -> DataFrame:
    """Fees of a rollup: sender pays execution and data fees; sequencer, base-fee vault and data vault earn them; deposits pay none but mint.

    ``tx``: tx_hash, sender, type, gas_used, effective_gas_price, base_fee, l1_fee, mint.
    """
    paid = F.col("gas_used") * F.col("effective_gas_price")
    base = F.col("gas_used") * F.coalesce("base_fee", F.lit(0))
    data = F.coalesce("l1_fee", F.lit(0))
    op = lambda kind, account, amount: F.struct(F.lit(kind).alias("type"), account.alias("account"), amount.cast("decimal(38,0)").alias("amount"))
    fees = F.array(op("FEE", F.col("sender"), -(paid + data)), op("FEE", F.lit("sequencer"), paid - base), op("FEE", F.lit("base_vault"), base), op("FEE", F.lit("data_vault"), data))
    mint = F.array(op("MINT", F.col("sender"), F.coalesce("mint", F.lit(0))))
    ops = F.filter(F.when(F.col("type") == DEPOSIT, mint).otherwise(fees), lambda o: o["amount"] != 0)
    return tx.select("tx_hash", F.posexplode(ops).alias("op_index", "o")).select("tx_hash", "op_index", "o.type", "o.account", "o.amount")


def transfer_ops(transfers: DataFrame) -> DataFrame:
    """PAYMENT pairs of token transfers (tx_hash, log_index, token, from_address, to_address, value, succeeded) of more than nothing."""
    pair = F.array(F.struct(F.col("from_address").alias("account"), (-F.col("value")).alias("amount")), F.struct(F.col("to_address").alias("account"), F.col("value").alias("amount")))
    moving = transfers.where(F.col("value") > 0)
    status = F.when(F.col("succeeded"), "SUCCESS").otherwise("FAILURE")
    return moving.select("tx_hash", "log_index", "token", status.alias("status"), F.posexplode(pair).alias("side", "op")).select("tx_hash", (F.col("log_index") * 2 + F.col("side")).alias("op_index"), "token", "status", "op.account", "op.amount")


def withdrawal_ops(withdrawals: DataFrame) -> DataFrame:
    """Validators' withdrawals in wei, each a ledger transaction of its own."""
    return withdrawals.select(F.col("ledger_tx").alias("tx_hash"), F.lit("WITHDRAWAL").alias("type"), F.col("address").alias("account"), (F.col("gwei").cast("decimal(20,0)") * F.lit(GWEI).cast("decimal(10,0)")).cast("decimal(38,0)").alias("amount"))


def destroyed(ops: DataFrame, destructions: DataFrame) -> DataFrame:
    """What accounts that were destroyed held at the end of their transaction: a DESTRUCT operation takes it, less than nothing is an error.

    ``ops``: tx_hash, op_index, account, amount, status.  ``destructions``: tx_hash, account,
    op_index (of the call that destroyed it).  Operations after the destruction count.
    Accounts are in order, so results don't depend on any map's.
    """
    once = destructions.groupBy("tx_hash", "account").agg(F.min("op_index").alias("from_index"))
    later = ops.where("status = 'SUCCESS'").join(once, ["tx_hash", "account"]).where(F.col("op_index") > F.col("from_index"))
    left = later.groupBy("tx_hash", "account").agg(F.sum("amount").alias("left"))
    return left.where("left != 0").select("tx_hash", "account", (-F.col("left")).alias("amount"), F.when(F.col("left") > 0, "DESTRUCT").otherwise("ERROR").alias("type"))


def reward_or_fee(rewards: DataFrame) -> DataFrame:
    """Solana rewards as operations; what is taken from an account is a fee."""
    return rewards.where("lamports != 0").select("height", F.col("pubkey").alias("account"), F.col("lamports").alias("amount"), F.when(F.col("lamports") < 0, "FEE").otherwise("REWARD").alias("type"))


def numbered(ops: DataFrame, by: str, *order: str) -> DataFrame:
    """Running operation index within each transaction."""
    from pyspark.sql import Window

    return ops.withColumn("op_index", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)
