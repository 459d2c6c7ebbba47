"""Ledger blocks: all balance changes of each transaction of a block, numbered through.

Operations of a transaction are arrays in its row, put one after another and exploded with
their position, so numbering takes no window and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.functions.crypto import keccak256
from chainloom.functions.scalars import clean_address
from chainloom.operators.ledger import GWEI
from chainloom.operators.native import NULL_ADDRESS

# Fixed values of Polygon's and the bridge's contracts.
BURN_CONTRACT = "0x70bca57f4579f58670ab2d18ef16e02c17553c38"
TOKEN_DEPOSITED = "0xec3afb067bce33c5a294470ec5b29e6759301cd3928550490c6d48816cdc2f5d"
NATIVE_TOPIC = "0x0000000000000000000000000000000000000000000000000000000000001010"
NATIVE_TOKEN = "0x0000000000000000000000000000000000001010"
LOG_TRANSFER = "0xe6497e3ee548a3372136af2fcb0696db31fc6cf20260707645068bd3fe97f3c4"
HOP_BRIDGE = "0x553bc791d746767166fa3888432038193ceed5e2"
HOP_SWAP = "0x3d4cc8a61c7528fd86c55cfe061a78dcba48edd1"
HOP_SWAPPED = "0xc6c1e0630dbe9130cc068028486c0d118ddcea348550819defd5cb8c257f8a38"
HOP_COMPLETED = "0x320958176930804eb66c2343c7343fc0367dc16249590c0f195783bee199d094"
BOR_PREFIX = b"matic-bor-receipt-"

_AMOUNT = "decimal(38,0)"
_OP = "struct<type string, status string, account string, amount decimal(38,0), token string>"
_OPS = f"array<{_OP}>"
_NONE = "array<struct<type:string,status:string,account:string,amount:decimal(38,0),token:string>>"


def _op(kind, status, account: Column, amount: Column, token: Column | None = None) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(kind).alias("type"), lit(status).alias("status"), account.alias("account"), amount.cast(_AMOUNT).alias("amount"), (F.lit(None).cast("string") if token is None else token).alias("token"))


def _none() -> Column:
    return F.array().cast(_NONE)


def _word(data: Column, k: int) -> Column:
    """The k-th 32-byte word of 0x data as a number; null above 120 bits."""
    from chainloom.functions.scalars import hex_to_decimal

    return hex_to_decimal(F.concat(F.lit("0x"), F.substr(data, F.lit(3 + 64 * k), F.lit(64))))


def evm_fee(chain: str, recipient: Column) -> Column:
    """Fee operations of a transaction: gas used times its effective price; the base fee's part burns.

    Ethereum: the sender pays the miner the rest and loses what burns.  Polygon: what burns
    goes to its contract, and a transaction without a fee has no operations.  No recipient:
    none.
    """
    gas = F.col("gas_used").cast("decimal(19,0)")
    price = F.when(F.col("type") == 2, F.col("effective_gas_price")).otherwise(F.col("gas_price")).cast("decimal(19,0)")
    fee, burnt = (gas * price).cast(_AMOUNT), (gas * F.col("base_fee").cast("decimal(19,0)")).cast(_AMOUNT)
    earned = fee - F.coalesce(burnt, F.lit(0).cast(_AMOUNT))
    sender = F.col("from_address")
    pair = F.array(_op("FEE", "SUCCESS", sender, -earned), _op("FEE", "SUCCESS", recipient, earned))
    lost = [_op("FEE", "SUCCESS", sender, -burnt)]
    if chain == "polygon":
        lost.append(_op("FEE", "SUCCESS", F.lit(BURN_CONTRACT), burnt))
    ops = F.when(burnt.isNull(), pair).otherwise(F.concat(pair, F.array(*lost)))
    none = recipient.isNull() | fee.isNull()
    return F.when(none | (fee == 0) if chain == "polygon" else none, _none()).otherwise(ops)


def evm_token_ops() -> Column:
    """PAYMENT pairs of ERC-20 transfers of more than nothing."""
    status = F.when(F.col("succeeded"), "SUCCESS").otherwise("FAILURE")

    def pair(x):
        value = _word(F.concat(F.lit("0x"), x["value_hex"]), 0)
        return F.array(_op("PAYMENT", status, x["from_address"], -value, x["token"]), _op("PAYMENT", status, x["to_address"], value, x["token"]))

    moving = F.filter("token_transfers", lambda x: (x["standard"] == "ERC20") & (_word(F.concat(F.lit("0x"), x["value_hex"]), 0) > 0))
    return F.coalesce(F.flatten(F.transform(moving, pair)), _none())


def evm_trace_ops() -> Column:
    """Pairs of the traces that move value; calls of nothing, delegate calls and call codes move none."""
    def pair(x):
        value, status = x["value"].cast(_AMOUNT), F.when(x["status"] == 1, "SUCCESS").otherwise("FAILURE")
        return F.array(_op(x["type"], status, x["from_address"], -value), _op(x["type"], status, x["to_address"], value))

    moving = F.filter("traces", lambda x: ((x["value"] != "0") | (x["trace_type"] != "CALL")) & ~x["type"].isin("CALLCODE", "DELEGATECALL"))
    return F.coalesce(F.flatten(F.transform(moving, pair)), _none())


def _topic(x, k: int) -> Column:
    return F.lower(F.get(x["topics"], F.lit(k)))


def polygon_log_transfers() -> Column:
    """Native transfers that a transaction from nobody to nobody logs."""
    def fits(x):
        return (F.lower(x["address"]) == NATIVE_TOKEN) & (F.size(x["topics"]) >= 4) & (_topic(x, 0) == LOG_TRANSFER) & (_topic(x, 1) == NATIVE_TOPIC)

    def pair(x):
        both = lambda value: F.array(_op("CALL", "SUCCESS", clean_address(_topic(x, 2)), -value), _op("CALL", "SUCCESS", clean_address(_topic(x, 3)), value))
        return F.get(F.transform(F.array(_word(x["data"], 0)), both), F.lit(0))

    nobody = (F.col("from_address") == NULL_ADDRESS) & (F.col("to_address") == NULL_ADDRESS)
    return F.when(nobody, F.flatten(F.transform(F.filter("logs", fits), pair))).otherwise(_none())


def polygon_bridge() -> Column:
    """What the bridge pays out: the last swap's tokens bought, to the last receiver completed."""
    swaps = F.filter("logs", lambda x: (F.lower(x["address"]) == HOP_SWAP) & (F.size(x["topics"]) >= 2) & (_topic(x, 0) == HOP_SWAPPED) & (F.length(x["data"]) > 130))
    done = F.filter("logs", lambda x: (F.lower(x["address"]) == HOP_BRIDGE) & (F.size(x["topics"]) >= 2) & (_topic(x, 0) == HOP_COMPLETED))
    # the last of each by a lambda's variable: written out, they would be looked for anew at each of a dozen uses
    last = lambda logs: F.slice(logs, -1, 1)
    paid = F.transform(last(swaps), lambda s: F.transform(last(done), lambda d: _op("PAYMENT", "SUCCESS", clean_address(_topic(d, 1)), _word(s["data"], 1))))
    return F.coalesce(F.filter(F.flatten(paid), lambda o: o["amount"].isNotNull() & o["account"].isNotNull()), _none())


def bor_hash(number, block_hash) -> Column:
    """Hash of the transaction that a Polygon block's state sync makes."""
    key = F.concat(F.lit(BOR_PREFIX), F.unhex(F.lpad(F.hex(number), 16, "0")), F.unhex(F.lpad(F.substr(block_hash, F.lit(3)), 64, "0")))
    return F.concat(F.lit("0x"), F.lower(F.hex(keccak256(key))))


def polygon_deposits(synced: Column) -> Column:
    """Deposits of the native token that a block's state-sync transaction logs."""
    def fits(x):
        return (_topic(x, 0) == TOKEN_DEPOSITED) & (_topic(x, 2) == NATIVE_TOPIC)

    made = F.transform(F.filter("logs", fits), lambda x: _op("PAYMENT", "SUCCESS", clean_address(_topic(x, 3)), _word(x["data"], 0)))
    return F.when(synced & F.col("logs").isNotNull(), made).otherwise(_none())


#: What the operations of a transaction are made of, on Ethereum.
EVM_FIELDS = ["tx_hash", "from_address", "type", "gas_price", "gas_used", "effective_gas_price", "traces"]


def evm_ledger(transactions: DataFrame, chain: str = "ethereum") -> DataFrame:
    """(number, tx_hash, op_index, type, status, account, amount, token) of native transactions.

    Fees, then tokens (Polygon), then traces, then what only Polygon's logs tell; the fee's
    recipient is the miner, on Polygon the author.
    """
    rows, ops = _evm_ops(transactions, chain)
    return numbered(rows, ops, F.col("number"), F.col("tx_hash")).select("number", "tx_hash", "op_index", "o.*")


def numbered(rows: DataFrame, ops: Column, *columns: Column) -> DataFrame:
    """``columns`` with each operation of the list ``ops`` as ``o`` and its place as ``op_index``.

    The list is made by a projection, as a generator that holds functions of arrays is
    interpreted whole; and the explode is an outer one, as an inner one brings a filter
    that makes the list again.
    """
    made = rows.select(*columns, ops.alias("_ops"))
    return made.select(*made.columns[:-1], F.posexplode_outer("_ops").alias("op_index", "o")).where("op_index is not null")


def _evm_ops(transactions: DataFrame, chain: str) -> tuple[DataFrame, Column]:
    """Rows of transactions, and the list of each one's operations."""
    polygon = chain == "polygon"
    rows = transactions.withColumn("_sync", F.col("tx_hash") == bor_hash("number", "hash")) if polygon else transactions
    parts = [evm_fee(chain, F.col("author" if polygon else "miner"))]
    if polygon:
        parts += [evm_token_ops()]
    parts += [evm_trace_ops()]
    if polygon:
        parts += [polygon_log_transfers(), polygon_bridge(), polygon_deposits(F.col("_sync"))]
    return rows, F.concat(*[F.coalesce(p, _none()) for p in parts])


def evm_ledger_blocks(blocks: DataFrame, chain: str = "ethereum") -> DataFrame:
    """Operations of native blocks: of their transactions, and of withdrawals, each a transaction of its own.

    Both come from one list of a block's row, so that a block is read and parsed once.
    """
    head = ["number", "hash", "block_ts", "miner", "author", "base_fee"]
    tx, paid = (blocks.schema[c].dataType for c in ("transactions", "withdrawals"))
    both = F.concat(
        F.transform(F.coalesce("transactions", F.array().cast(tx)), lambda t: F.struct(t.alias("t"), F.lit(None).cast(paid.elementType).alias("w"))),
        F.transform(F.coalesce("withdrawals", F.array().cast(paid)), lambda w: F.struct(F.lit(None).cast(tx.elementType).alias("t"), w.alias("w"))),
    )
    each = blocks.select(*head, F.explode(both).alias("e")).select(*head, F.col("e.w").alias("w"), "e.t.*")
    rows, ops = _evm_ops(each, chain)
    wei = (F.col("w.gwei").cast("decimal(20,0)") * F.lit(GWEI).cast("decimal(10,0)")).cast(_AMOUNT)
    of_withdrawal = F.array(_op("WITHDRAWAL", "SUCCESS", F.col("w.address"), wei))
    name = F.when(F.col("w").isNull(), F.col("tx_hash")).otherwise(F.concat_ws("_", F.lit("WITHDRAWAL"), "hash", F.col("w.withdrawal_index").cast("string")))
    every = F.when(F.col("w").isNull(), ops).otherwise(of_withdrawal)
    return numbered(rows, every, F.col("number"), name.alias("tx_hash")).select("number", "tx_hash", "op_index", "o.*")


# --------------------------------------------------------------------- Solana

_CHANGES = "array<struct<account string, token string, change decimal(38,0)>>"
_BALANCE = "array<struct<accountIndex int, mint string, owner string, uiTokenAmount struct<amount string>>>"
_REWARD = "array<struct<pubkey string, lamports bigint, rewardType string>>"
SOLANA_BLOCK = (
    "struct<blockhash string, previousBlockhash string, parentSlot bigint, blockHeight bigint, blockTime bigint, rewards " + _REWARD + ", "
    "transactions array<struct<transaction struct<signatures array<string>, message struct<accountKeys array<struct<pubkey string, signer boolean, writable boolean>>, instructions array<string>>>, "
    "meta struct<err string, fee bigint, preBalances array<decimal(20,0)>, postBalances array<decimal(20,0)>, preTokenBalances " + _BALANCE + ", postTokenBalances " + _BALANCE + ", "
    "innerInstructions array<struct<index int, instructions array<string>>>, rewards " + _REWARD + ">>>>"
)


def solana_blocks(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Native Solana blocks (slot, tag, skipped, payload): one nested row each; a skipped slot keeps its number only.

    Blocks of tags below 2 get ``parse_error``, as do blocks whose hash or transactions lack.
    """
    parsed = raw.select("*", F.explode(F.array(F.from_json(payload, SOLANA_BLOCK))).alias("b"))
    real = ~F.col("skipped")
    lacks = [F.when(F.col(f"b.{c}").isNull(), F.lit(c)) for c in ("blockhash", "transactions")]
    lacks = F.array_join(F.array_compact(F.array(*lacks)), ",")
    error = F.when(real & (F.col("tag") < 2), F.lit("not implemented")).when(real & (lacks != ""), F.concat(F.lit("block lacks "), lacks))

    def transaction(x, i):
        ids = x["transaction"]["signatures"]
        keys = x["transaction"]["message"]["accountKeys"]
        inner = F.flatten(F.transform(x["meta"]["innerInstructions"], lambda y: y["instructions"]))
        return F.struct(
            i.alias("position"),
            F.get(ids, F.lit(0)).alias("tx_id"),
            F.transform(keys, lambda k: k["pubkey"]).alias("accounts"),
            F.nullif(x["meta"]["err"], F.lit("null")).alias("err"),
            x["meta"]["fee"].alias("fee"),
            F.coalesce(x["transaction"]["message"]["instructions"], F.array().cast("array<string>")).alias("instructions"),
            F.coalesce(inner, F.array().cast("array<string>")).alias("inner_instructions"),
            x["meta"]["preBalances"].alias("pre"),
            x["meta"]["postBalances"].alias("post"),
            x["meta"]["preTokenBalances"].alias("pre_tokens"),
            x["meta"]["postTokenBalances"].alias("post_tokens"),
            x["meta"]["rewards"].alias("rewards"),
        )

    # transactions stand behind a generator too: a filter on a list of them (an explode brings its own) doesn't make them again
    made = parsed.select("*", F.explode(F.array(F.struct(F.when(real, F.transform("b.transactions", transaction)).alias("transactions")))).alias("t"))
    return made.select(
        "slot",
        "skipped",
        F.when(real, F.col("b.blockhash")).alias("hash"),
        F.when(real, F.col("b.previousBlockhash")).alias("parent_hash"),
        F.when(real, F.col("b.parentSlot")).alias("parent_slot"),
        F.when(real, F.timestamp_seconds("b.blockTime")).alias("block_ts"),
        F.col("t.transactions").alias("transactions"),
        F.when(real, F.col("b.rewards")).alias("rewards"),
        error.alias("parse_error"),
    )


def _solana_moves(texts: Column) -> Column:
    """(source, destination, lamports, third, vote) of each of a list of instructions' JSON.

    In steps, each of which looks at a text once for what the step before has found: a
    lambda has no common subexpressions, so one that names its program's text twice reads it twice.
    """
    from chainloom.operators.parse_other import SOLANA_MOVES, SOLANA_STILL

    at = lambda text, path: F.get_json_object(text, path)
    keyed = F.transform(texts, lambda x: F.struct(x.alias("text"), F.concat_ws("/", F.coalesce(at(x, "$.program"), F.lit("")), F.coalesce(at(x, "$.parsed.type"), F.lit(""))).alias("key")))

    def side(x, k):
        out = F
        for (p, kind), names in SOLANA_MOVES.items():
            out = out.when(x["key"] == f"{p}/{kind}", at(x["text"], f"$.parsed.info.{names[k]}"))
        return out

    sided = F.transform(keyed, lambda x: F.struct(x["text"].alias("text"), x["key"].alias("key"), side(x, 0).alias("source"), side(x, 1).alias("destination")))
    still = [f"{p}/{t}" for p, t in SOLANA_STILL]
    moves = lambda x: x["source"].isNotNull() & x["destination"].isNotNull()
    return F.transform(
        sided,
        lambda x: F.struct(
            x["source"].alias("source"),
            x["destination"].alias("destination"),
            F.when(moves(x), at(x["text"], "$.parsed.info.lamports").cast(_AMOUNT)).alias("lamports"),
            (~x["key"].isin(*still) & ~moves(x)).alias("third"),
            x["key"].isin("vote/vote", "vote/compactupdatevotestate").alias("vote"),
        ),
    )


def _token_sums(balances: Column, accounts: Column) -> Column:
    """Token balances by mint and owner (the account itself where no owner is named), added up."""
    owned = F.transform(
        F.coalesce(balances, F.array().cast(_BALANCE)),
        lambda b: F.struct(b["mint"].alias("mint"), F.coalesce(F.nullif(b["owner"], F.lit("")), F.get(accounts, b["accountIndex"])).alias("owner"), b["uiTokenAmount"]["amount"].cast(_AMOUNT).alias("amount")),
    )
    keys = F.array_distinct(F.transform(owned, lambda b: F.struct(b["mint"].alias("mint"), b["owner"].alias("owner"))))
    return F.transform(
        keys,
        lambda k: F.struct(
            k["mint"].alias("mint"),
            k["owner"].alias("owner"),
            F.aggregate(F.filter(owned, lambda b: (b["mint"] == k["mint"]) & (b["owner"] == k["owner"])), F.lit(0).cast(_AMOUNT), lambda a, b: (a + b["amount"]).cast(_AMOUNT)).alias("amount"),
        ),
    )


def _solana_transactions(blocks: DataFrame) -> DataFrame:
    """One row per transaction of native blocks."""
    return blocks.where("transactions is not null").select("slot", F.explode("transactions").alias("t")).select("slot", "t.*")


def _solana_ops(each: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Rows of transactions, and of them the list of operations and whether they are votes.

    The list is a column to explode as it is: as one of the rows' own it would be made twice,
    once for the filter that an explode of a named list brings.
    """
    each = each.withColumn("moves", _solana_moves(F.concat("instructions", "inner_instructions")))  # used more than once, so it stays a column
    status = F.when(F.coalesce("err", F.lit("")) != "", "FAILURE").otherwise("SUCCESS")
    payer = F.get("accounts", F.lit(0))
    fee = F.when(F.col("fee") > 0, F.array(_op("FEE", "SUCCESS", payer, -F.col("fee")))).otherwise(_none())
    reward = lambda r: _op(F.when(r["lamports"] < 0, "FEE").otherwise("REWARD"), status, r["pubkey"], r["lamports"])
    first = F.concat(fee, F.coalesce(F.transform(F.filter("rewards", lambda r: r["lamports"] != 0), reward), _none()))
    pairs = F.flatten(
        F.transform(F.filter("moves", lambda m: m["lamports"].isNotNull()), lambda m: F.array(_op("TRANSFER", status, m["source"], -m["lamports"]), _op("TRANSFER", status, m["destination"], m["lamports"])))
    )
    third = F.exists("moves", lambda m: m["third"])
    # token balances are added up only where another program makes them operations
    before, after = (F.when(F.col("third"), _token_sums(F.col(c), F.col("accounts"))) for c in ("pre_tokens", "post_tokens"))
    each = each.withColumns({"first": first, "third": third}).withColumn("tok", F.struct(before.alias("b"), after.alias("a")))
    explained = lambda account: F.aggregate(
        F.filter("first", lambda o: (o["account"] == account) & (o["status"] == "SUCCESS")), F.lit(0).cast(_AMOUNT), lambda a, o: (a + o["amount"]).cast(_AMOUNT)
    )
    changes = F.transform("accounts", lambda a, i: _op("TRANSFER", "SUCCESS", a, F.get("post", i) - F.get("pre", i) - explained(a)))
    amount = lambda side, k: F.coalesce(F.get(F.filter(f"tok.{side}", lambda x: (x["mint"] == k["mint"]) & (x["owner"] == k["owner"])), F.lit(0))["amount"], F.lit(0).cast(_AMOUNT))
    keys = F.array_sort(F.array_union(*[F.transform(f"tok.{s}", lambda x: F.struct(x["mint"].alias("mint"), x["owner"].alias("owner"))) for s in "ba"]))
    tokens = F.transform(keys, lambda k: _op("TRANSFER", "SUCCESS", k["owner"], amount("a", k) - amount("b", k), k["mint"]))
    derived = F.filter(F.concat(changes, tokens), lambda o: o["amount"] != 0)
    ops = F.concat("first", F.when(F.col("third"), F.coalesce(derived, _none())).otherwise(F.coalesce(pairs, _none())))
    vote = (F.size("instructions") == 1) & (F.size("inner_instructions") == 0) & F.get("moves", F.lit(0))["vote"]
    return each, ops, F.coalesce(vote, F.lit(False))


def solana_ledger(blocks: DataFrame) -> DataFrame:
    """(slot, tx_id, op_index, type, status, account, amount, token, is_vote) of native blocks.

    A transaction pays its fee from its first account, whatever becomes of it, then gets its
    rewards (less than nothing: a fee), then come the pairs of its instructions and inner
    instructions.  With any instruction of another program these pairs are left out: the
    changes of balances that fee and rewards don't explain come instead, then those of
    tokens.  Rewards of a block are a transaction under the block's hash, put behind the
    block's own ones, so that a block is read once for both.
    """
    kind = blocks.schema["transactions"].dataType
    known = {"tx_id": F.col("hash"), "rewards": F.col("rewards"), "accounts": F.array(), "instructions": F.array(), "inner_instructions": F.array()}
    of_block = F.struct(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.elementType.fields])
    every = F.concat(F.coalesce("transactions", F.array().cast(kind)), F.array(of_block))
    each, ops, vote = _solana_ops(blocks.select("slot", F.explode(every).alias("t")).select("slot", "t.*"))
    made = each.select("slot", "tx_id", vote.alias("is_vote"), F.posexplode(ops).alias("op_index", "o"))
    return made.select("slot", "tx_id", "op_index", "o.*", "is_vote")


def solana_residuals(blocks: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """(slot, tx_id, account, token, residual): where balances before and successful operations don't make balances after.

    Without a ledger, blocks are held against the operations of their own transactions: all
    of a transaction is in its row then, and nothing is shuffled or read twice.
    """
    zero = F.lit(0).cast(_AMOUNT)
    change = lambda account, token, amount: F.struct(account.alias("account"), token.alias("token"), amount.cast(_AMOUNT).alias("change"))
    native = F.transform("accounts", lambda a, i: change(a, F.lit(None).cast("string"), F.get("post", i) - F.get("pre", i)))
    signed = lambda c, sign: F.transform(_token_sums(F.col(c), F.col("accounts")), lambda x: change(x["owner"], x["mint"], x["amount"] * sign))
    held = F.concat(F.coalesce(native, F.array().cast(_CHANGES)), signed("pre_tokens", -1), signed("post_tokens", 1))
    keys = ["slot", "tx_id", "account", "token"]
    if ledger is not None:
        each = _solana_transactions(blocks)
        moved = ledger.where("status = 'SUCCESS'").join(each.select("slot", "tx_id"), ["slot", "tx_id"], "left_semi").select(*keys, (-F.col("amount")).cast(_AMOUNT).alias("change"))
        both = each.select("slot", "tx_id", F.explode(held).alias("c")).select("slot", "tx_id", "c.*").unionByName(moved)
        return both.groupBy(*keys).agg(F.coalesce(F.sum("change"), zero).cast(_AMOUNT).alias("residual")).where("residual != 0")
    each, ops, _ = _solana_ops(_solana_transactions(blocks))
    moved = F.transform(F.filter(ops, lambda o: o["status"] == "SUCCESS"), lambda o: change(o["account"], o["token"], -o["amount"]))
    each = each.select("slot", "tx_id", F.explode(F.array(F.concat(held, moved))).alias("changes"))
    same = lambda x, k: x["account"].eqNullSafe(k["account"]) & x["token"].eqNullSafe(k["token"])
    total = lambda k: F.aggregate(F.filter("changes", lambda x: same(x, k) & x["change"].isNotNull()), zero, lambda a, x: (a + x["change"]).cast(_AMOUNT))
    sums = F.transform(F.array_distinct(F.transform("changes", lambda x: F.struct(x["account"].alias("account"), x["token"].alias("token")))), lambda k: F.struct(k["account"].alias("account"), k["token"].alias("token"), total(k).alias("residual")))
    left = each.select("slot", "tx_id", F.explode(F.array(F.filter(sums, lambda x: x["residual"] != 0))).alias("left"))
    return left.select("slot", "tx_id", F.explode("left").alias("r")).select("slot", "tx_id", "r.*")


def index_faults(ledger: DataFrame, by: list[str]) -> DataFrame:
    """Transactions whose operations aren't numbered 0, 1, 2 and so on."""
    of = ledger.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct("op_index").alias("ids"), F.min("op_index").alias("low"), F.max("op_index").alias("high"))
    return of.where((F.col("low") != 0) | (F.col("high") != F.col("n") - 1) | (F.col("ids") != F.col("n"))).select(*by, "n")
