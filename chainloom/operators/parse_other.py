"""Payloads of the other chain families: Bitcoin, Solana, Aptos, beacon and Rosetta."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.functions.crypto import pubkey_address

# -------------------------------------------------------------------- Bitcoin

BITCOIN = (
    "struct<hash string, height bigint, previousblockhash string, merkleroot string, time bigint, difficulty double, "
    "tx array<struct<txid string, hash string, vsize bigint, vin array<struct<txid string, vout bigint>>, "
    "vout array<struct<value decimal(18,8), n bigint, scriptPubKey struct<asm string, type string, address string, addresses array<string>>>>>>>"
)


def bitcoin_blocks(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Headers with ``b`` (the block); the difficulty is a string of two decimals."""
    b = raw.withColumn("b", F.from_json(payload, BITCOIN))
    gone = F.array_compact(F.array(*[F.when(F.col(f"b.{f}").isNull(), F.lit(f)) for f in ("hash", "height", "time", "tx")]))
    return b.select("*", F.col("b.hash").alias("hash"), F.col("b.height").alias("height"), F.timestamp_seconds("b.time").alias("block_ts"), F.format_string("%.2f", "b.difficulty").alias("difficulty"), F.when(F.size(gone) > 0, F.concat(F.lit("block lacks "), F.array_join(gone, ","))).alias("parse_error"))


def bitcoin_outputs(blocks: DataFrame) -> DataFrame:
    """Outputs in satoshi; the address is the script's one, or the first of several unless it is multisig, or that of the key that a pubkey script names; data carriers are OP_RETURN."""
    each = blocks.select("height", F.explode("b.tx").alias("t")).select("height", F.col("t.txid").alias("tx"), F.explode("t.vout").alias("o"))
    script = F.col("o.scriptPubKey")
    key = F.nullif(F.regexp_extract(script["asm"], "^([0-9a-fA-F]+) OP_CHECKSIG$", 1), F.lit(""))
    address = F.when(script["type"] == "nulldata", "OP_RETURN").when((script["type"] == "pubkey") & script["address"].isNull(), pubkey_address(key)).when(script["type"] == "multisig", F.lit(None)).otherwise(F.coalesce(script["address"], F.get(script["addresses"], F.lit(0))))
    return each.select("height", "tx", F.col("o.n").alias("n"), F.round(F.col("o.value") * 100_000_000).cast("bigint").alias("value"), address.alias("address"))


def bitcoin_inputs(blocks: DataFrame) -> DataFrame:
    """Inputs that spend something; those that mint have no previous output."""
    each = blocks.select("height", F.explode("b.tx").alias("t")).select("height", F.col("t.txid").alias("tx"), F.posexplode("t.vin").alias("i", "v"))
    return each.where(F.col("v.txid").isNotNull()).select("height", "tx", "i", F.col("v.txid").alias("prev_tx"), F.col("v.vout").alias("prev_n"))


def bitcoin_mints(blocks: DataFrame) -> DataFrame:
    """Whether each transaction mints: its first input spends nothing."""
    first = F.get(F.col("t.vin"), F.lit(0))
    return blocks.select("height", F.posexplode("b.tx").alias("position", "t")).select("height", F.col("t.txid").alias("tx"), "position", (first.isNotNull() & first["txid"].isNull()).alias("mints"))


# --------------------------------------------------------------------- Solana

#: Programs whose instructions are told apart, and which kinds of each; others are kept raw.
SOLANA_PROGRAMS = {
    "address-lookup-table": [],
    "bpf-loader": [],
    "bpf-upgradeable-loader": [],
    "vote": ["initialize", "vote", "withdraw", "compactupdatevotestate"],
    "system": ["createAccount", "transfer", "createAccountWithSeed", "transferWithSeed"],
    "stake": ["initialize", "delegate", "deactivate", "merge", "split", "withdraw"],
    "spl-memo": [],
    "spl-token": ["getAccountDataSize", "initializeImmutableOwner", "transfer"],
    "spl-token-2022": [],
    "spl-associated-token-account": [],
    "": [],
}
#: Kinds that move lamports, and from whom to whom.
SOLANA_MOVES = {
    ("system", "transfer"): ("source", "destination"),
    ("system", "transferWithSeed"): ("source", "destination"),
    ("system", "createAccount"): ("source", "newAccount"),
    ("system", "createAccountWithSeed"): ("source", "newAccount"),
    ("stake", "split"): ("stakeAccount", "newSplitAccount"),
    ("stake", "withdraw"): ("stakeAccount", "destination"),
    ("vote", "withdraw"): ("voteAccount", "destination"),
}
SOLANA_STILL = [("stake", "initialize"), ("stake", "delegate"), ("stake", "deactivate"), ("vote", "initialize"), ("vote", "vote"), ("vote", "compactupdatevotestate")]


def solana_instructions(raw: DataFrame, payload: str = "instruction") -> DataFrame:
    """Instructions by program and kind (UNKNOWN if the program's kind isn't told apart, MEMO and RAW for those); a program that isn't known gets ``parse_error``."""
    v = F.try_parse_json(payload)
    get = lambda path, kind="string": F.try_variant_get(v, path, kind)
    program = F.coalesce(get("$.program"), F.lit(""))
    kind = get("$.parsed.type")
    named = F.lit(None).cast("string")
    for p, kinds in SOLANA_PROGRAMS.items():
        if kinds:
            named = F.when((program == p) & kind.isin(*kinds), kind).otherwise(named)
    label = F.when(program == "", "RAW").when(program == "spl-memo", "MEMO").otherwise(F.coalesce(named, F.lit("UNKNOWN")))
    moves = lambda side: F.coalesce(*[F.when((program == p) & (kind == k), get(f"$.parsed.info.{names[side]}")) for (p, k), names in SOLANA_MOVES.items()])
    still = F.lit(False)
    for p, k in SOLANA_STILL:
        still = still | ((program == p) & F.coalesce(kind == k, F.lit(False)))
    source = moves(0)
    return raw.select(
        *[c for c in raw.columns if c != payload],
        program.alias("program"),
        label.alias("kind"),
        source.alias("source"),
        moves(1).alias("destination"),
        F.when(source.isNotNull(), get("$.parsed.info.lamports", "bigint")).alias("lamports"),
        F.when(program == "spl-memo", get("$.parsed")).alias("memo"),
        (source.isNull() & ~still).alias("third_party"),
        F.when(~program.isin(*SOLANA_PROGRAMS), F.concat(F.lit("unknown program "), program)).alias("parse_error"),
    )


def solana_native_ops(instructions: DataFrame) -> DataFrame:
    """Pairs of operations of transactions made of native instructions only; others are left to their balances."""
    third = instructions.groupBy("tx").agg(F.bool_or("third_party").alias("third"))
    native = instructions.join(third.where(~F.col("third")).select("tx"), "tx", "left_semi").where("lamports is not null")
    pair = F.array(F.struct(F.col("source").alias("account"), (-F.col("lamports")).alias("amount")), F.struct(F.col("destination").alias("account"), F.col("lamports").alias("amount")))
    return native.select("tx", "i", F.posexplode(pair).alias("side", "op")).select("tx", (F.col("i") * 2 + F.col("side")).alias("op_index"), "op.account", "op.amount")


def solana_error(payload) -> Column:
    """null, a string, or the one key of an object."""
    text = F.col(payload)
    return F.when(F.startswith(F.trim(text), F.lit("{")), F.get(F.json_object_keys(text), F.lit(0))).otherwise(F.nullif(F.regexp_replace(text, '^"|"$', ""), F.lit("null")))


def solana_transaction_id(signatures) -> Column:
    return F.get(F.col(signatures), F.lit(0))


# ---------------------------------------------------------------------- Aptos

APTOS_TRANSACTIONS = {"block_metadata_transaction": "BLOCK_METADATA", "state_checkpoint_transaction": "STATE_CHECKPOINT", "genesis_transaction": "GENESIS", "user_transaction": "USER", "validator_transaction": "VALIDATOR"}
APTOS_CHANGES = ["delete_module", "delete_resource", "delete_table_item", "write_module", "write_resource", "write_table_item"]
APTOS_PAYLOADS = ["entry_function_payload", "script_payload", "module_bundle_payload", "multisig_payload", "write_set_payload"]


def aptos_transactions(raw: DataFrame, payload: str = "transaction") -> DataFrame:
    """Transactions by kind, with their info; times are whole seconds of microseconds; entry functions are split into address, module and name."""
    v = F.try_parse_json(payload)
    get = lambda path, kind="string": F.try_variant_get(v, path, kind)
    kinds = F.create_map(*[F.lit(x) for pair in APTOS_TRANSACTIONS.items() for x in pair])
    kind = kinds[get("$.type")]
    function = F.split(get("$.payload.function"), "::")
    return raw.select(
        *[c for c in raw.columns if c != payload],
        kind.alias("kind"),
        get("$.version").cast("bigint").alias("version"),
        get("$.hash").alias("tx_hash"),
        get("$.success", "boolean").alias("success"),
        F.timestamp_seconds(F.floor(get("$.timestamp").cast("bigint") / 1_000_000)).alias("ts"),
        F.when(get("$.payload.type").isin(*APTOS_PAYLOADS), get("$.payload.type")).alias("payload_type"),
        F.get(function, F.lit(0)).alias("module_address"),
        F.get(function, F.lit(1)).alias("module_name"),
        F.get(function, F.lit(2)).alias("function_name"),
        F.when(kind.isNull(), F.concat(F.lit("unknown transaction "), F.coalesce(get("$.type"), F.lit("null")))).alias("parse_error"),
    )


def aptos_changes(raw: DataFrame, payload: str = "transaction") -> DataFrame:
    """Write-set changes by kind; those not known get ``parse_error``."""
    changes = F.from_json(F.get_json_object(payload, "$.changes"), "array<struct<type string, address string, state_key_hash string, module string, resource string, handle string, key string, value string>>")
    each = raw.select(*[c for c in raw.columns if c != payload], F.posexplode(changes).alias("position", "c"))
    return each.select(*[c for c in raw.columns if c != payload], "position", F.col("c.type").alias("kind"), "c.address", "c.state_key_hash", F.when(~F.coalesce(F.col("c.type").isin(*APTOS_CHANGES), F.lit(False)), F.lit("unknown change")).alias("parse_error"))


# --------------------------------------------------------------------- beacon

BEACON_VERSIONS = ["phase0", "altair", "bellatrix", "capella", "deneb"]
SLOTS_PER_EPOCH = 32


def beacon_blocks(raw: DataFrame, header: str = "header", block: str = "block") -> DataFrame:
    """Headers and blocks of slots: what each fork added is null before it; a slot or root that isn't the one asked for is an error.

    ``raw``: slot, root and both payloads.
    """
    h, b = F.try_parse_json(header), F.try_parse_json(block)
    hget = lambda path, kind="string": F.try_variant_get(h, path, kind)
    bget = lambda path, kind="string": F.try_variant_get(b, path, kind)
    version = bget("$.version")
    at = F.coalesce(*[F.when(version == v, F.lit(i)) for i, v in enumerate(BEACON_VERSIONS)])
    slot = hget("$.data.header.message.slot").cast("bigint")
    since = lambda n, c: F.when(at >= n, c)
    body = "$.data.message.body"
    error = F.when(slot != F.col("slot"), "another slot").when(hget("$.data.root") != F.col("root"), "another root").when(at.isNull(), "unknown version")
    return raw.select(
        "slot",
        "root",
        F.floor(F.col("slot") / SLOTS_PER_EPOCH).alias("epoch"),
        version.alias("version"),
        hget("$.data.header.message.proposer_index").cast("bigint").alias("proposer_index"),
        since(2, bget(f"{body}.execution_payload.block_number").cast("bigint")).alias("execution_block_number"),
        since(3, F.size(bget(f"{body}.execution_payload.withdrawals", "array<variant>"))).alias("n_withdrawals"),
        since(4, F.size(bget(f"{body}.blob_kzg_commitments", "array<string>"))).alias("n_blobs"),
        error.alias("parse_error"),
    )


def beacon_blobs(blocks: DataFrame, blobs: DataFrame) -> DataFrame:
    """Blobs by their place against the block's commitments; ``matches`` is false where they differ or one is missing."""
    c = blocks.select("slot", F.posexplode("commitments").alias("position", "commitment"))
    both = c.join(blobs.select("slot", "position", F.col("commitment").alias("found")), ["slot", "position"], "full_outer")
    return both.withColumn("matches", F.col("commitment").eqNullSafe(F.col("found")))


# -------------------------------------------------------------------- Rosetta

ROSETTA = (
    "struct<block struct<block_identifier struct<index bigint, hash string>, parent_block_identifier struct<index bigint, hash string>, timestamp bigint, "
    "transactions array<struct<transaction_identifier struct<hash string>, operations array<struct<operation_identifier struct<index bigint>, type string, status string, "
    "account struct<address string>, amount struct<value string, currency struct<symbol string, decimals int>>>>>>>, other_transactions array<struct<hash string>>>"
)


def rosetta_ops(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Operations of ledger blocks; times are milliseconds; values stay decimal strings, as they may pass 38 digits."""
    b = raw.select(F.from_json(payload, ROSETTA)["block"].alias("b"))
    tx = b.select(F.col("b.block_identifier.index").alias("height"), F.col("b.block_identifier.hash").alias("block_hash"), F.timestamp_millis("b.timestamp").alias("block_ts"), F.explode("b.transactions").alias("t"))
    op = tx.select("height", "block_hash", "block_ts", F.col("t.transaction_identifier.hash").alias("tx_hash"), F.explode("t.operations").alias("o"))
    return op.select("height", "block_hash", "block_ts", "tx_hash", F.col("o.operation_identifier.index").alias("op_index"), F.col("o.type").alias("type"), F.col("o.status").alias("status"), F.col("o.account.address").alias("account"), F.col("o.amount.value").alias("value"), F.col("o.amount.currency.symbol").alias("symbol"), F.col("o.amount.currency.decimals").alias("decimals"))


def genesis_allocations(spark, path: str) -> DataFrame:
    """Allocations of a network's genesis file as operations of one transaction per account."""
    rows = spark.read.schema("account_identifier struct<address string>, currency struct<symbol string, decimals int>, value string").json(path, multiLine=True)
    return rows.select(F.concat(F.lit("GENESIS_"), "account_identifier.address").alias("tx_hash"), F.lit("GENESIS").alias("type"), F.col("account_identifier.address").alias("account"), "value", F.col("currency.symbol").alias("symbol"), F.col("currency.decimals").alias("decimals"))
