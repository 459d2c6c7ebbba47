"""Queries of the operators over the test tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.config import TEST_CHAIN
from chainloom.functions import scalars as S
from chainloom.operators import continuity, fold, ledger, parse_evm, parse_other, reads, reorg, verify
from chainloom.sources import derived
from chainloom.sources.derived import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, plain: bool = False):
    """Register a query under its function's name; ``sql`` follows the derived tables unless ``plain``."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql if plain else derived.SQL + sql
        return f

    return add


_BLOCK = "tag, height, hash, parent_hash, parent_height, skipped, block_ts"


@query("SELECT tag, height FROM tip")
def r1_latest_block(spark, d):
    return reads.latest_block(derived.watermarks(spark, d), 1)


@query(f"SELECT {_BLOCK} FROM canonical WHERE tag = 1 AND height = 1157")
def r2_block_by_height(spark, d):
    return reads.block_by_height(derived.block_writes(spark, d), 1, 1157)


@query(f"SELECT {_BLOCK} FROM block_writes WHERE height = 1157 AND hash = md5('1157-stale')")
def r3_block_by_hash(spark, d):
    import hashlib

    return reads.block_by_hash(derived.block_writes(spark, d), 1, 1157, hashlib.md5(b"1157-stale").hexdigest())


@query(f"SELECT {_BLOCK} FROM canonical WHERE height >= 100 AND height < 1300")
def r4_blocks_by_range(spark, d):
    return reads.checked_range(derived.block_writes(spark, d), derived.watermarks(spark, d), TEST_CHAIN, 0, 100, 1300)


_HEIGHTS = [900, 7, 7, 56, 5, 1400, 3]


@query(f"SELECT pos, 1 AS tag, a.height, hash, parent_hash, parent_height, skipped, block_ts FROM (SELECT unnest([0,1,2,3,4,5,6]) AS pos, unnest({_HEIGHTS}) AS height) a LEFT JOIN canonical c ON a.height = c.height")
def r5_blocks_by_heights(spark, d):
    return reads.blocks_by_heights(derived.block_writes(spark, d), 1, _HEIGHTS)


@query("SELECT event_tag, event_id, event_type, tag, height, hash, parent_hash, skipped, block_ts FROM events0 WHERE event_id = 500")
def r6_event_by_id(spark, d):
    return reads.event_by_id(derived.chain_events(spark, d), 500, 1_000_000_000)


@query("SELECT event_id, event_type, height, hash FROM events0 WHERE event_id >= 10 AND event_id < 300")
def r7_events_by_range(spark, d):
    return reads.events_by_range(derived.chain_events(spark, d), 10, 300).select("event_id", "event_type", "height", "hash")


@query("SELECT event_id, event_type, height, hash FROM events0 WHERE event_id > 700 AND event_id <= 750")
def r8_events_after(spark, d):
    return reads.events_after(derived.chain_events(spark, d), 700, 50, 1_000_000_000).select("event_id", "event_type", "height", "hash")


@query("SELECT event_tag, max(event_id) AS max_event_id FROM all_events GROUP BY 1")
def r9_max_event_id(spark, d):
    return reads.last_event(derived.chain_events(spark, d).unionByName(derived.chain_events(spark, d, 1)))


@query("SELECT event_tag, height, min(event_id) AS event_id FROM all_events WHERE height = 81 GROUP BY 1, 2")
def r10_first_event_of_height(spark, d):
    both = derived.chain_events(spark, d).unionByName(derived.chain_events(spark, d, 1))
    return reads.first_event_of_height(both, 81)


@query("SELECT event_id, event_type, hash FROM events1 WHERE height = 81")
def r11_events_of_height(spark, d):
    return reads.events_of_height(derived.chain_events(spark, d, 1), 81).select("event_id", "event_type", "hash")


@query("SELECT tx_hash, block_number, block_hash FROM tx_index WHERE tx_hash = (SELECT min(tx_hash) FROM tx_index WHERE block_hash = md5(block_number || '-orphan'))")
def r12_transaction(spark, d):
    index = derived.tx_index(spark, d)
    first = index.where(F.col("block_hash") == F.md5(F.concat(F.col("block_number").cast("string"), F.lit("-orphan")))).agg(F.min("tx_hash")).first()[0]
    return reads.transaction(index, 1, first)


@query("SELECT height, hash FROM canonical WHERE height IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def r14_batched_keys(spark, d):
    keys = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("height"))
    return reads.by_keys(reads.canonical_blocks(derived.block_writes(spark, d)), keys, ["height"], complete=True).select("height", "hash")


@query("SELECT tag, height, skipped, hash, parent_hash, CASE WHEN NOT skipped THEN 'TESTCHAIN/LOCAL/1/' || height || '/' || hash || '.gzip' END AS file_url, CASE WHEN NOT skipped THEN 'GZIP' END AS compression FROM canonical")
def q2_block_files(spark, d):
    return reads.files_projection(reads.canonical_blocks(derived.block_writes(spark, d)), TEST_CHAIN)


@query("SELECT t.tag, tx_hash, block_number, block_hash, parent_hash, block_ts FROM tx_index t JOIN canonical c ON t.tag = c.tag AND block_number = height AND block_hash = hash")
def q8_blocks_of_transactions(spark, d):
    return reads.blocks_of_transactions(derived.tx_index(spark, d), derived.block_writes(spark, d)).select("tag", "tx_hash", "block_number", "block_hash", "parent_hash", "block_ts")


@query("SELECT 'EARLIEST' AS position, 0 AS cursor_id UNION ALL SELECT 'LATEST', max(event_id) - 1 FROM events0 UNION ALL SELECT '200', min(event_id) - 1 FROM events0 WHERE height = 200 UNION ALL SELECT 'sequence', 77")
def q12_cursor_resolution(spark, d):
    events = derived.chain_events(spark, d)
    at = {p: reads.resolve_cursor(events, initial_position=p) for p in ("EARLIEST", "LATEST", "200")} | {"sequence": reads.resolve_cursor(events, sequence="77", initial_position="LATEST")}
    return spark.createDataFrame(list(at.items()), "position string, cursor_id bigint")


@query("SELECT 1 AS latest_tag, 1 AS stable_tag, 1 AS latest_event_tag, 0 AS stable_event_tag, 0 AS block_start_height, 12 AS irreversible_distance, '12s' AS block_time")
def q14_chain_metadata(spark, d):
    return reads.chain_metadata(spark, TEST_CHAIN)


@query("SELECT s.event_id, max(t.event_id) AS target_event_id FROM events0 s JOIN events1 t ON s.height = t.height AND s.hash IS NOT DISTINCT FROM t.hash AND s.parent_hash IS NOT DISTINCT FROM t.parent_hash AND s.event_type = t.event_type AND s.skipped = t.skipped AND s.tag = t.tag GROUP BY 1")
def q15_versioned_events(spark, d):
    return reads.versioned_events(derived.chain_events(spark, d), derived.chain_events(spark, d, 1))


@query(
    "SELECT client, second, cost, sum(cost) OVER (PARTITION BY second) AS total, cost > 9 AS client_over, sum(cost) OVER (PARTITION BY second) > 40 AS global_over FROM (SELECT user_id AS client, date_trunc('second', ts) AS second, sum(CASE event_type WHEN 'click' THEN 10 WHEN 'purchase' THEN 50 ELSE 1 END) AS cost FROM events GROUP BY 1, 2)",
    plain=True,
)
def q17_rate_limits(spark, d):
    calls = table(spark, d, "events").select(F.col("user_id").alias("client"), F.col("event_type").alias("method"), "ts")
    return reads.rate_limits(calls, 9, 40, {"click": 10, "purchase": 50})


@query("SELECT count(*) AS n_blocks, 0 AS n_violations FROM canonical WHERE NOT skipped")
def c1_validate_chain(spark, d):
    blocks = reads.canonical_blocks(derived.block_writes(spark, d))
    bad = continuity.validate_chain(blocks, bucket=1000).agg(F.count("*").alias("n_violations"))
    return blocks.where(~F.col("skipped")).agg(F.count("*").alias("n_blocks")).crossJoin(bad)  # one row each


@query("SELECT height, hash, parent_hash, lag(hash) OVER (ORDER BY height) AS expected_parent_hash FROM (SELECT height, parent_hash, CASE WHEN height % 50 = 7 THEN md5(height || '-stale') ELSE hash END AS hash FROM canonical WHERE NOT skipped) QUALIFY parent_hash <> lag(hash) OVER (ORDER BY height)")
def c1_broken_chain(spark, d):
    """Violations of a chain in which stale blocks stand among the canonical ones."""
    blocks = reads.canonical_blocks(derived.block_writes(spark, d))
    broken = blocks.withColumn("hash", F.when((F.col("height") % 50 == 7) & ~F.col("skipped"), F.md5(F.concat(F.col("height").cast("string"), F.lit("-stale")))).otherwise(F.col("hash")))
    return continuity.validate_chain(broken, bucket=1000).select("height", "hash", "parent_hash", "expected_parent_hash")


@query("SELECT event_tag, event_id, lag(event_id) OVER (PARTITION BY event_tag ORDER BY event_id) AS previous_event_id FROM all_events WHERE event_id % 97 <> 0 QUALIFY event_id <> lag(event_id) OVER (PARTITION BY event_tag ORDER BY event_id) + 1")
def c3_event_ids(spark, d):
    both = derived.chain_events(spark, d).unionByName(derived.chain_events(spark, d, 1)).where("event_id % 97 != 0")
    return continuity.validate_event_ids(both, bucket=1000)


@query("SELECT event_tag, count(*) AS n_events, 0 AS n_violations FROM all_events GROUP BY 1")
def c2_event_pairs(spark, d):
    both = derived.chain_events(spark, d).unionByName(derived.chain_events(spark, d, 1))
    bad = continuity.validate_event_pairs(both, bucket=1000).groupBy("event_tag").agg(F.count("*").alias("bad"))
    return both.groupBy("event_tag").agg(F.count("*").alias("n_events")).join(bad, "event_tag", "left").select("event_tag", "n_events", F.coalesce("bad", F.lit(0)).alias("n_violations"))


@query("SELECT event_tag, CAST(floor(event_id / 500) AS BIGINT) AS part, '' AS error FROM events0 GROUP BY 1, 2")
def c16_event_stack(spark, d):
    return fold.stack_errors(derived.chain_events(spark, d), 500)


_LAST_EVENT = "FROM (SELECT * FROM events0 {w} QUALIFY row_number() OVER (PARTITION BY height ORDER BY event_id DESC) = 1) WHERE event_type = 'BLOCK_ADDED'"


@query("SELECT event_tag, height, event_id, tag, hash, parent_hash, skipped " + _LAST_EVENT.format(w=""))
def c5_canonical_from_events(spark, d):
    return continuity.canonical_from_events(derived.chain_events(spark, d))


@query("SELECT event_tag, height, event_id, tag, hash, parent_hash, skipped " + _LAST_EVENT.format(w="WHERE event_id <= 1001"))
def c6_chain_as_of(spark, d):
    return continuity.canonical_from_events(derived.chain_events(spark, d), as_of=1001)


@query("SELECT max(height) FILTER (WHERE height < m AND height % 17 <> 5) AS fork_height, m AS mismatch_height FROM canonical, (SELECT min(height) AS m FROM canonical WHERE height > (SELECT max(o_orderkey) - 25 FROM orders) AND height % 17 <> 5) GROUP BY m")
def c7_fork_height(spark, d):
    mine = reads.canonical_blocks(derived.block_writes(spark, d))
    top = table(spark, d, "orders").agg(F.max("o_orderkey").alias("top"))
    theirs = mine.crossJoin(F.broadcast(top)).withColumn("hash", F.when((F.col("height") > F.col("top") - 25) & ~F.col("skipped"), F.md5(F.concat(F.col("height").cast("string"), F.lit("b")))).otherwise(F.col("hash")))  # one row on the right
    return reorg.fork_height(mine, theirs)


@query("SELECT distance, CASE WHEN distance >= 12 THEN 'error' ELSE 'success' END AS result FROM (SELECT unnest([0, 1, 11, 12, 50]) AS distance)", plain=True)
def c9_reorg_distance(spark, d):
    return continuity.reorg_distance(spark.createDataFrame([(x,) for x in (0, 1, 11, 12, 50)], "distance int"), 12)


_FORKED = """, ends AS (SELECT (SELECT max(event_id) - 60 FROM events0) AS e, (SELECT max(height) - 120 FROM canonical) AS h
), held AS (SELECT height, hash, parent_hash, skipped, tag FROM (SELECT * FROM events0 WHERE event_id <= (SELECT e FROM ends) QUALIFY row_number() OVER (PARTITION BY height ORDER BY event_id DESC) = 1) WHERE event_type = 'BLOCK_ADDED'
), newer AS (SELECT c.height, c.tag, c.parent_hash, c.skipped, CASE WHEN c.height > (SELECT h FROM ends) AND NOT c.skipped THEN md5(c.height || '-new') ELSE c.hash END AS hash FROM canonical c
), fork AS (SELECT max(h.height) AS f FROM held h JOIN newer n ON h.height = n.height AND h.hash IS NOT DISTINCT FROM n.hash AND h.skipped = n.skipped
), last AS (SELECT max(event_id) AS m FROM events0 WHERE event_id <= (SELECT e FROM ends))
SELECT event_type, tag, height, hash, parent_hash, skipped, 0 AS event_tag, m + row_number() OVER (ORDER BY k, CASE WHEN k = 0 THEN -height ELSE height END) AS event_id FROM (
  SELECT 0 AS k, 'BLOCK_REMOVED' AS event_type, tag, height, hash, parent_hash, skipped FROM held, fork WHERE height > f
  UNION ALL SELECT 1, 'BLOCK_ADDED', tag, height, hash, parent_hash, skipped FROM newer, fork WHERE height > f AND height <= f + 200), last"""


@query(derived.SQL.rstrip() + _FORKED, plain=True)
def c12_streamer_cycle(spark, d):
    blocks = reads.canonical_blocks(derived.block_writes(spark, d))
    events = derived.chain_events(spark, d)
    end, top = events.agg(F.max("event_id")).first()[0] - 60, blocks.agg(F.max("height")).first()[0] - 120
    newer = blocks.withColumn("hash", F.when((F.col("height") > top) & ~F.col("skipped"), F.md5(F.concat(F.col("height").cast("string"), F.lit("-new")))).otherwise(F.col("hash")))
    events = events.where(F.col("event_id") <= end)
    return reorg.streamer_changes(events, newer, 0, 200).select("event_type", "tag", "height", "hash", "parent_hash", "skipped", "event_tag", "event_id")


@query("SELECT height, hash, skipped OR height > (SELECT max(height) - 9 FROM canonical) AS skipped FROM canonical WHERE height <= (SELECT max(height) FROM canonical WHERE NOT skipped AND height <= (SELECT max(height) - 9 FROM canonical))")
def c13_trim_trailing_skipped(spark, d):
    blocks = reads.canonical_blocks(derived.block_writes(spark, d))
    top = blocks.agg(F.max("height")).first()[0]
    blocks = blocks.withColumn("skipped", F.col("skipped") | (F.col("height") > top - 9))
    return continuity.trim_trailing_skipped(blocks).select("height", "hash", "skipped")


@query("SELECT max(height) AS height, max(height) <= max(m) - 20 AS agrees FROM canonical, (SELECT max(height) AS m FROM canonical) WHERE height <= m - 12 + 1 AND NOT skipped")
def c14_consensus(spark, d):
    mine = reads.canonical_blocks(derived.block_writes(spark, d))
    top = mine.agg(F.max("height")).first()[0]
    theirs = mine.withColumn("hash", F.when((F.col("height") > top - 20) & ~F.col("skipped"), F.lit("other")).otherwise(F.col("hash")))
    return reorg.consensus(mine, theirs, top, 12)


@query("SELECT 2 AS event_tag, event_id, event_type, 3 AS tag, e.height, CASE WHEN e.hash IS NOT DISTINCT FROM c.hash THEN e.hash END AS hash, CASE WHEN e.hash IS NOT DISTINCT FROM c.hash THEN e.parent_hash END AS parent_hash, e.hash IS DISTINCT FROM c.hash OR e.skipped AS skipped FROM events0 e JOIN canonical c ON e.height = c.height")
def c15_reconcile_events(spark, d):
    blocks = reads.canonical_blocks(derived.block_writes(spark, d)).withColumn("tag", F.lit(3))
    return reorg.reconcile_events(derived.chain_events(spark, d), blocks, 2)


@query("SELECT height, hash, 2 AS tag, CASE WHEN height % 7 = 0 THEN 'patched' ELSE parent_hash END AS parent_hash FROM canonical")
def c17_upgrade(spark, d):
    blocks = reads.canonical_blocks(derived.block_writes(spark, d)).where(~F.col("skipped"))
    patches = blocks.where("height % 7 = 0").select("height", "hash", F.lit("patched").alias("parent_hash"))
    skipped = reads.canonical_blocks(derived.block_writes(spark, d)).where(F.col("skipped")).select("height", "hash", F.lit(2).alias("tag"), F.when(F.col("height") % 7 == 0, "patched").otherwise(F.col("parent_hash")).alias("parent_hash"))
    return reorg.upgrade(blocks, patches, 1, 2, "parent_hash").select("height", "hash", "tag", "parent_hash").unionByName(skipped)


@query("SELECT account, sum(amount) AS balance, count(*) AS n_ops FROM ledger_ops WHERE status = 'SUCCESS' GROUP BY 1")
def l1_account_balances(spark, d):
    return ledger.account_balances(derived.ledger_ops(spark, d))


@query("SELECT account, CASE WHEN balance % 10 = 3 THEN 1 ELSE -2 END AS amount FROM (SELECT account, sum(amount) AS balance FROM ledger_ops WHERE status = 'SUCCESS' GROUP BY 1) WHERE balance % 10 IN (3, 4)")
def l13_balance_reconciliation(spark, d):
    ops = derived.ledger_ops(spark, d)
    b = ledger.account_balances(ops)
    off = F.when(F.col("balance") % 10 == 3, 1).when(F.col("balance") % 10 == 4, -2).otherwise(0)
    return ledger.reconcile(ops, b.select("account", F.lit(100).alias("pre"), (F.lit(100) + F.col("balance") + off).alias("post")))


_TOKENS = "SELECT l_suppkey AS owner, l_partkey % 5 AS mint, CAST(sum(l_quantity) AS BIGINT) AS amount FROM lineitem WHERE l_returnflag = '{f}' GROUP BY 1, 2"


@query(f"SELECT * FROM (SELECT coalesce(a.owner, b.owner) AS owner, coalesce(a.mint, b.mint) AS mint, coalesce(b.amount, 0) - coalesce(a.amount, 0) AS amount FROM ({_TOKENS.format(f='A')}) a FULL JOIN ({_TOKENS.format(f='R')}) b ON a.owner = b.owner AND a.mint = b.mint) WHERE amount <> 0", plain=True)
def l14_token_deltas(spark, d):
    line = table(spark, d, "lineitem")
    side = lambda f: line.where(F.col("l_returnflag") == f).groupBy(F.col("l_suppkey").alias("owner"), (F.col("l_partkey") % 5).alias("mint")).agg(F.sum("l_quantity").cast("bigint").alias("amount"))
    return ledger.token_deltas(side("A"), side("R"), ["owner", "mint"])


@query(
    "SELECT tx_hash, op_index, 'FEE' AS type, account, amount FROM (SELECT md5(o_orderkey || 'tx') AS tx_hash, f, unnest([0, 1, 2]) AS op_index, unnest(['c' || o_custkey, 'miner', 'c' || o_custkey]) AS account, unnest([-(g * p - g * coalesce(f, 0)), g * p - g * coalesce(f, 0), -g * f]) AS amount FROM (SELECT *, 21000 + o_orderkey AS g, 30 + o_custkey % 70 AS p, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey % 25 END AS f FROM orders)) WHERE op_index < 2 OR f IS NOT NULL",
    plain=True,
)
def l3_fee_ops(spark, d):
    o = table(spark, d, "orders")
    fee = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey") % 25)
    tx = o.select(F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit("tx"))).alias("tx_hash"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("sender"), F.lit("miner").alias("miner"), (F.lit(21000) + F.col("o_orderkey")).alias("gas_used"), (30 + F.col("o_custkey") % 70).alias("effective_gas_price"), fee.alias("base_fee"))
    return ledger.fee_ops(tx)


@query(
    "SELECT height, account, CAST(amount AS VARCHAR) AS amount FROM (SELECT h AS height, 'm' || h AS account, r + n * (r // 32) AS amount FROM (SELECT *, CAST(CASE WHEN h < 4370000 THEN 5 WHEN h < 7280000 THEN 3 WHEN h < 15537394 THEN 2 ELSE 0 END AS HUGEINT) * 1000000000000000000 AS r FROM (SELECT o_orderkey * 1200 AS h, o_custkey % 3 AS n FROM orders)) UNION ALL SELECT h, 'u' || k, (8 - k) * r // 8 FROM (SELECT h, r, unnest(range(1, n + 1)) AS k FROM (SELECT *, CAST(CASE WHEN h < 4370000 THEN 5 WHEN h < 7280000 THEN 3 WHEN h < 15537394 THEN 2 ELSE 0 END AS HUGEINT) * 1000000000000000000 AS r FROM (SELECT o_orderkey * 1200 AS h, o_custkey % 3 AS n FROM orders)))) WHERE amount <> 0",
    plain=True,
)
def l5_block_rewards(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderkey") * 1200).alias("height"), (F.col("o_custkey") % 3).alias("n"))
    uncles = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1))), lambda k: F.struct((F.col("height") - k).alias("height"), F.concat(F.lit("u"), k.cast("string")).alias("miner")))).otherwise(F.array())
    blocks = o.select("height", F.concat(F.lit("m"), F.col("height").cast("string")).alias("miner"), uncles.alias("uncles"))
    return ledger.reward_ops(blocks).select("height", "account", F.col("amount").cast("string").alias("amount"))


_KIND = "CASE l_linenumber % 4 WHEN 0 THEN 'CALL' WHEN 1 THEN 'DELEGATECALL' WHEN 2 THEN 'CREATE' ELSE 'CALLCODE' END"


@query(
    f"SELECT md5(l_orderkey || '-' || l_partkey || '-' || l_suppkey) AS tx_hash, 2 * l_linenumber + side AS op_index, {_KIND} AS type, CASE WHEN l_returnflag = 'R' THEN 'FAILURE' ELSE 'SUCCESS' END AS status, CASE side WHEN 0 THEN 'a' || l_partkey ELSE 'b' || l_suppkey END AS account, CASE side WHEN 0 THEN -v ELSE v END AS amount FROM (SELECT *, CAST(l_quantity AS BIGINT) % 10 AS v FROM lineitem), (SELECT unnest([0, 1]) AS side) WHERE {_KIND} IN ('CALL', 'CREATE') AND (v <> 0 OR {_KIND} <> 'CALL')",
    plain=True,
)
def l2_trace_ops(spark, d):
    n = F.col("l_linenumber") % 4
    kind = F.when(n == 0, "CALL").when(n == 1, "DELEGATECALL").when(n == 2, "CREATE").otherwise("CALLCODE")
    text = lambda *c: F.concat_ws("-", *[F.col(x).cast("string") for x in c])
    traces = table(spark, d, "lineitem").select(F.md5(text("l_orderkey", "l_partkey", "l_suppkey")).alias("tx_hash"), F.col("l_linenumber").alias("trace_index"), kind.alias("type"), F.concat(F.lit("a"), text("l_partkey")).alias("sender"), F.concat(F.lit("b"), text("l_suppkey")).alias("receiver"), (F.col("l_quantity").cast("bigint") % 10).alias("value"), (F.col("l_returnflag") == "R").alias("failed"))
    return ledger.trace_ops(traces)


_UTXO = """WITH outputs AS (SELECT 'p' || l_partkey AS tx, l_suppkey AS n, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE 'addr' || l_suppkey END AS address, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS value FROM lineitem GROUP BY 1, 2, 3
), inputs AS (SELECT 'o' || l_orderkey AS tx, 'p' || l_partkey AS prev_tx, CASE WHEN l_linenumber = 6 THEN l_suppkey + 100000 ELSE l_suppkey END AS prev_n FROM lineitem
), spent AS (SELECT i.tx, i.prev_tx, i.prev_n, address AS prev_address, value AS prev_value, value IS NOT NULL AS found FROM inputs i LEFT JOIN outputs o ON i.prev_tx = o.tx AND i.prev_n = o.n)
"""


def _utxo(spark, d):
    line = table(spark, d, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    outputs = line.groupBy(name("p", "l_partkey").alias("tx"), F.col("l_suppkey").alias("n")).agg(F.sum(cents).alias("value")).withColumn("address", F.when(F.col("n") % 4 != 0, name("addr", "n")))
    inputs = line.select(name("o", "l_orderkey").alias("tx"), name("p", "l_partkey").alias("prev_tx"), F.when(F.col("l_linenumber") == 6, F.col("l_suppkey") + 100000).otherwise(F.col("l_suppkey")).alias("prev_n"))
    return inputs, outputs


@query(_UTXO + "SELECT tx, prev_tx, prev_n, prev_address, prev_value, found FROM spent", plain=True)
def x13_utxo_inputs(spark, d):
    return ledger.utxo_inputs(*_utxo(spark, d)).select("tx", "prev_tx", "prev_n", "prev_address", "prev_value", "found")


@query(
    _UTXO + "SELECT o.tx, coalesce(iv, 0) AS input_value, coalesce(ic, 0) AS input_count, ov AS output_value, oc AS output_count, CASE WHEN coalesce(iv, 0) = 0 THEN 0 ELSE iv - ov END AS fee FROM (SELECT tx, sum(v) AS ov, count(*) AS oc FROM (SELECT 'o' || l_orderkey AS tx, CAST(l_quantity AS BIGINT) AS v FROM lineitem) GROUP BY 1) o LEFT JOIN (SELECT tx, sum(prev_value) AS iv, count(*) AS ic FROM spent WHERE found GROUP BY 1) i ON o.tx = i.tx",
    plain=True,
)
def x12_transaction_totals(spark, d):
    spent = ledger.utxo_inputs(*_utxo(spark, d)).where("found")
    made = table(spark, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("tx"), F.col("l_quantity").cast("bigint").alias("value"))
    return ledger.utxo_totals(spent, made)


@query(_UTXO + "SELECT tx, 'INPUT' AS type, coalesce(prev_address, prev_tx || ':' || prev_n) AS account, -prev_value AS amount, prev_tx || ':' || prev_n AS coin, 'SUCCESS' AS status FROM spent WHERE found UNION ALL SELECT tx, 'OUTPUT', coalesce(address, tx || ':' || n), value, CASE WHEN address <> 'OP_RETURN' THEN tx || ':' || n END, 'SUCCESS' FROM outputs", plain=True)
def l11_utxo_ops(spark, d):
    inputs, outputs = _utxo(spark, d)
    return ledger.utxo_ops(ledger.utxo_inputs(inputs, outputs).where("found"), outputs)


@query("SELECT height, CASE WHEN height % 50 = 7 THEN 'hash' ELSE 'missing' END AS differences FROM canonical WHERE (height % 50 = 7 AND NOT skipped) OR height % 50 = 9 UNION ALL SELECT height + 10000000, 'unexpected' FROM canonical WHERE height < 3")
def v1_compare_blocks(spark, d):
    blocks = reads.canonical_blocks(derived.block_writes(spark, d))
    other = blocks.where("height % 50 != 9").withColumn("hash", F.when((F.col("height") % 50 == 7) & ~F.col("skipped"), F.lit("x")).otherwise(F.col("hash")))
    return verify.compare_blocks(blocks, other.unionByName(blocks.where("height < 3").withColumn("height", F.col("height") + 10000000)))


@query("SELECT 'hash' AS differences, count(*) AS n FROM canonical WHERE height % 50 = 7 AND NOT skipped")
def v8_monitor(spark, d):
    writes = derived.block_writes(spark, d)
    stored = writes.where("write_seq % 2 = 0").select("height", F.col("hash").alias("stale"))
    blocks = reads.canonical_blocks(writes)
    off = blocks.join(stored, "height", "left").withColumn("hash", F.coalesce("stale", "hash")).drop("stale")
    return verify.monitor_counts(blocks, off, 0, blocks.agg(F.max("height")).first()[0])


@query("SELECT height FROM canonical WHERE FALSE UNION ALL SELECT height FROM (SELECT height, sum(amount) AS r FROM ledger_ops WHERE status = 'SUCCESS' AND account <> 's1' GROUP BY 1) WHERE r <> 0")
def v6_ledger_residuals(spark, d):
    return verify.ledger_residuals(derived.ledger_ops(spark, d).where("account != 's1'")).select("height")


@query("SELECT event_tag, count(*) AS n, max(event_id) - count(DISTINCT event_id) AS missing, count(*) - count(DISTINCT event_id) AS repeated FROM (SELECT event_tag, event_id FROM all_events WHERE event_id % 97 <> 0 UNION ALL SELECT event_tag, event_id FROM all_events WHERE event_id % 1000 = 1) GROUP BY 1")
def v8_event_gaps(spark, d):
    both = derived.chain_events(spark, d).unionByName(derived.chain_events(spark, d, 1))
    return verify.event_gaps(both.where("event_id % 97 != 0").unionByName(both.where("event_id % 1000 = 1")))


@query("SELECT user_id, CASE WHEN n > 40 THEN 'error' ELSE 'success' END AS sla, n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)", plain=True)
def m1_service_levels(spark, d):
    n = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", verify.service_level(F.col("n"), 40).alias("sla"), "n")


@query("SELECT o_custkey AS workflow_id FROM orders EXCEPT SELECT user_id FROM events", plain=True)
def m4_missing_workflows(spark, d):
    expected = table(spark, d, "orders").select(F.col("o_custkey").alias("workflow_id")).distinct()
    return verify.missing_workflows(expected, table(spark, d, "events").select(F.col("user_id").alias("workflow_id")))


@query("SELECT user_id, count(*) AS n FROM events WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 60 SECOND GROUP BY 1", plain=True)
def v10_liveness(spark, d):
    e = table(spark, d, "events")
    now = e.agg(F.max("ts")).first()[0]
    return e.where(F.col("ts") <= F.lit(now) - F.expr("INTERVAL 60 SECOND")).groupBy("user_id").agg(F.count("*").alias("n"))


_S = [(0,), (1,), (4294967295,), (7,)]


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 0 ELSE o_orderkey % 4 END AS tag FROM orders", plain=True)
def s1_effective_tag(spark, d):
    o = table(spark, d, "orders")
    raw = F.when(F.col("o_orderkey") % 4 == 1, F.lit(4294967295)).otherwise(F.col("o_orderkey") % 4)
    return o.select("o_orderkey", S.effective_tag(raw, 5).alias("tag"))


@query("SELECT o_orderkey, o_orderkey AS n, lower(to_hex(o_orderkey)) AS digits FROM orders", plain=True)
def s2_hex_quantities(spark, d):
    h = F.concat(F.lit("0x000"), F.hex("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", S.hex_to_long(h).alias("n"), S.clean_hex(h).alias("digits"))


@query("SELECT o_orderkey, '0x' || repeat('0', 40 - length(to_hex(o_orderkey))) || lower(to_hex(o_orderkey)) AS address FROM orders", plain=True)
def s3_clean_address(spark, d):
    topic = F.concat(F.lit("0x"), F.lpad(F.hex("o_orderkey"), 64, "0"))
    return table(spark, d, "orders").select("o_orderkey", S.clean_address(topic).alias("address"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey = 0 THEN NULL ELSE make_timestamp(o_orderkey * 1000000) END AS ts FROM orders", plain=True)
def s11_timestamps(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.to_timestamp("o_orderkey").alias("ts"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents", plain=True)
def s12_checksums(spark, d):
    return table(spark, d, "documents").select("doc_id", S.checksum_hex("text").alias("sha256"))


@query("SELECT o_orderkey, greatest(o_orderkey - 1, 0) AS parent_height, CAST(floor((o_orderkey - 10) / 25.0) AS BIGINT) AS batch FROM orders", plain=True)
def s17_s19_heights(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.parent_height("o_orderkey").alias("parent_height"), S.mini_batch("o_orderkey", 10, 25).alias("batch"))


@query("SELECT o_orderkey, lower(replace(o_orderpriority, ' ', '_')) AS client FROM orders", plain=True)
def q18_client_id(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.client_id(F.concat(F.lit(" "), "o_orderpriority", F.lit(": x "))).alias("client"))


# ------------------------------------------------------------------- payloads


def _hex(c):
    return F.concat(F.lit("0x"), F.lower(F.hex(c)))


def _md5(*parts):
    return F.md5(F.concat_ws("-", *[p.cast("string") for p in parts]))


def evm_raw(spark, d) -> DataFrame:
    """Raw EVM blocks: an order is a block, its lines are transactions; lines are gathered as the few numbers that their JSON is made of."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"))
    txs = spread(line, "l_orderkey").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "cents")).alias("rows"))

    def tx(r):
        even = r["l_linenumber"] % 2 == 0
        return F.struct(
            F.concat(F.lit("0x"), _md5(F.col("l_orderkey"), r["l_linenumber"], r["l_partkey"])).alias("hash"),
            F.concat(F.lit("0xA"), r["l_partkey"].cast("string")).alias("from"),
            F.concat(F.lit("0xB"), r["l_suppkey"].cast("string")).alias("to"),
            _hex(r["l_linenumber"]).alias("transactionIndex"),
            _hex(r["l_partkey"]).alias("nonce"),
            _hex(F.lit(21000) + r["l_partkey"]).alias("gas"),
            _hex(F.lit(100) + r["l_suppkey"]).alias("gasPrice"),
            F.when(even, _hex(F.lit(90) + r["l_suppkey"])).alias("maxFeePerGas"),
            F.when(even, _hex(r["l_partkey"] % 9)).alias("maxPriorityFeePerGas"),
            F.when(even, "0x2").alias("type"),
            F.concat(_hex(r["cents"]), F.lit("0000000000")).alias("value"),
        )

    o = table(spark, d, "orders")
    header = F.struct(
        _hex(F.col("o_orderkey")).alias("number"),
        F.when(F.col("o_orderkey") % 100 != 3, F.concat(F.lit("0x"), F.upper(_md5(F.col("o_orderkey"))))).alias("hash"),
        F.lit("0xP").alias("parentHash"),
        _hex(F.unix_timestamp("o_orderdate")).alias("timestamp"),
        _hex(F.lit(30000000) + F.col("o_custkey")).alias("gasLimit"),
        F.when(F.col("o_orderkey") % 3 != 0, _hex(F.col("o_custkey") % 50)).alias("baseFeePerGas"),
        F.transform("rows", tx).alias("transactions"),
    )
    # merged, as a broadcast of the thin rows would leave all JSON to the few tasks that read orders
    return o.join(txs.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.to_json(header).alias("header"))


_EVM_TX = """SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey % 50 END AS base, o_orderkey AS number FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


@query(
    "SELECT o_orderkey, o_orderkey AS number, CASE WHEN o_orderkey % 100 <> 3 THEN '0x' || md5(CAST(o_orderkey AS VARCHAR)) END AS hash, date_trunc('second', o_orderdate) AS block_ts, 30000000 + o_custkey AS gas_limit, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey % 50 END AS base_fee, CASE WHEN o_orderkey % 100 = 3 THEN 'header lacks hash' END AS parse_error FROM orders",
    plain=True,
)
def x2_evm_headers(spark, d):
    return parse_evm.parse_headers(evm_raw(spark, d)).select("o_orderkey", "number", "hash", "block_ts", "gas_limit", "base_fee", "parse_error")


@query(
    f"SELECT number, '0x' || md5(l_orderkey || '-' || l_linenumber || '-' || l_partkey) AS tx_hash, '0xa' || l_partkey AS from_address, '0xb' || l_suppkey AS to_address, l_partkey AS nonce, 21000 + l_partkey AS gas, 100 + l_suppkey AS gas_price, CAST(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS HUGEINT) * 1099511627776 AS VARCHAR) AS value, CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 0 END AS type, CASE WHEN base IS NULL THEN NULL WHEN l_linenumber % 2 = 0 THEN least(90 + l_suppkey - base, l_partkey % 9) ELSE 100 + l_suppkey - base END AS priority_fee FROM ({_EVM_TX})",
    plain=True,
)
def x3_evm_transactions(spark, d):
    return _transactions(evm_raw(spark, d))


def _transactions(raw: DataFrame) -> DataFrame:
    t = parse_evm.transactions(parse_evm.parse_headers(raw))
    return t.select("number", "tx_hash", "from_address", "to_address", "nonce", "gas", "gas_price", F.col("value").cast("string").alias("value"), "type", "priority_fee")


def evm_receipts(spark, d) -> DataFrame:
    line = table(spark, d, "lineitem")
    pad = lambda c: F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(c)), 64, "0"))
    topics = F.array(F.lit(parse_evm.TRANSFER), pad(F.col("l_partkey")), pad(F.col("l_suppkey")))
    long_topics = F.concat(topics, F.array(F.when(F.col("l_linenumber") == 4, F.lit("0xzz")).otherwise(pad(F.col("l_orderkey")))))
    n = F.col("l_linenumber") % 4
    log = F.struct(
        F.lit("0xTOKEN").alias("address"),
        F.when(n == 2, F.concat(F.lit("0x1"), F.repeat(F.lit("0"), F.lit(64)))).otherwise(pad(F.col("l_orderkey") + 7)).alias("data"),
        _hex(F.col("l_linenumber")).alias("logIndex"),
        F.when(n == 0, long_topics).when(n == 3, F.slice(topics, 1, 2)).otherwise(topics).alias("topics"),
    )
    receipt = F.struct(
        F.concat(F.lit("0x"), _md5(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"))).alias("transactionHash"),
        _hex(F.lit(21000) + F.col("l_suppkey")).alias("gasUsed"),
        F.when(F.col("l_returnflag") == "R", "0x0").when(F.col("l_returnflag") == "A", "0x1").alias("status"),
        F.when(F.col("l_returnflag") == "N", "0xroot").alias("root"),
        F.when(F.col("l_linestatus") == "O", _hex(F.col("l_partkey"))).alias("effectiveGasPrice"),
        F.array(log).alias("logs"),
    )
    return line.select(F.to_json(receipt).alias("receipt"))


@query("SELECT '0x' || md5(l_orderkey || '-' || l_linenumber || '-' || l_partkey) AS tx_hash, 21000 + l_suppkey AS gas_used, CASE l_returnflag WHEN 'R' THEN FALSE WHEN 'A' THEN TRUE END AS succeeded, CASE WHEN l_linestatus = 'O' THEN l_partkey END AS effective_gas_price FROM lineitem", plain=True)
def x4_evm_receipts(spark, d):
    return parse_evm.receipts(evm_receipts(spark, d)).select("tx_hash", "gas_used", "succeeded", "effective_gas_price")


@query(
    "SELECT '0x' || md5(l_orderkey || '-' || l_linenumber || '-' || l_partkey) AS tx_hash, l_linenumber AS log_index, '0xtoken' AS token, '0x' || right(repeat('0', 40) || lower(to_hex(l_partkey)), 40) AS from_address, '0x' || right(repeat('0', 40) || lower(to_hex(l_suppkey)), 40) AS to_address, CASE WHEN l_linenumber % 4 = 0 THEN 'ERC721' ELSE 'ERC20' END AS standard, right(repeat('0', 64) || lower(to_hex(CASE WHEN l_linenumber % 4 = 0 THEN l_orderkey ELSE l_orderkey + 7 END)), 64) AS value_hex FROM lineitem WHERE l_linenumber % 4 = 1 OR (l_linenumber % 4 = 0 AND l_linenumber <> 4)",
    plain=True,
)
def x10_token_transfers(spark, d):
    return _transfers(evm_receipts(spark, d))


def _transfers(raw: DataFrame) -> DataFrame:
    return parse_evm.token_transfers(parse_evm.receipt_logs(raw))


#: Queries of parsers, in two parts: what builds their payloads, and the parser.
PREPARED = {"x3_evm_transactions": (evm_raw, _transactions), "x10_token_transfers": (evm_receipts, _transfers)}


_TRACE = "SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS k, l_partkey, l_suppkey, l_linenumber, l_returnflag = 'R' AS bad FROM lineitem"


@query(
    f"SELECT md5(k) AS tx_hash, position, address AS trace_address, type, trace_type, CAST(v AS VARCHAR) AS value, subtraces, CASE WHEN bad AND position > 0 THEN 'reverted' END AS error, lower(trace_type) || '_' || md5(k) || CASE WHEN address = '' THEN '' ELSE '_' || replace(address, ',', '_') END AS trace_id FROM (SELECT k, bad, unnest([0, 1, 2, 3]) AS position, unnest(['', '0', '0,0', '1']) AS address, unnest(['CALL', 'DELEGATECALL', 'CREATE', 'STATICCALL']) AS type, unnest(['CALL', 'CALL', 'CREATE', 'CALL']) AS trace_type, unnest([l_partkey, 0, l_suppkey, 0]) AS v, unnest([2, 1, 0, 0]) AS subtraces FROM ({_TRACE})) ",
    plain=True,
)
def x6_flat_traces(spark, d):
    return _flat(trace_raw(spark, d))


def trace_raw(spark, d) -> DataFrame:
    line = table(spark, d, "lineitem")
    bad = F.col("l_returnflag") == "R"
    leaf = F.struct(F.lit("CREATE").alias("type"), _hex(F.col("l_suppkey")).alias("value"))
    inner = F.struct(F.lit("DELEGATECALL").alias("type"), F.when(bad, "reverted").alias("error"), F.array(leaf).alias("calls"))
    last = F.struct(F.lit("STATICCALL").alias("type"), F.when(bad, "reverted").alias("error"), F.lit(None).cast("array<struct<type string, value string>>").alias("calls"))
    root = F.struct(F.lit("CALL").alias("type"), _hex(F.col("l_partkey")).alias("value"), F.array(inner, last).alias("calls"))
    return line.select(_md5(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")).alias("tx_hash"), F.to_json(root).alias("trace"))


def _flat(raw: DataFrame) -> DataFrame:
    t = parse_evm.flat_traces(raw)
    return t.select("tx_hash", "position", F.array_join(F.col("trace_address").cast("array<string>"), ",").alias("trace_address"), "type", "trace_type", "value", "subtraces", "error", "trace_id")


@query(
    "SELECT o_orderkey AS tx, address AS trace_address, CASE WHEN o_orderkey % 3 = 0 AND address IN ('0', '0,0', '0,0,2') THEN CASE WHEN o_orderkey % 2 = 0 AND address IN ('0,0', '0,0,2') THEN 'inner' ELSE 'outer' END WHEN o_orderkey % 2 = 0 AND address IN ('0,0', '0,0,2') THEN 'inner' END AS inherited FROM orders, (SELECT unnest(['', '0', '0,0', '0,0,2', '1']) AS address)",
    plain=True,
)
def x8_parity_errors(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    step = lambda address, error: F.struct(F.array(*[F.lit(x) for x in address]).cast("array<int>").alias("trace_address"), error.alias("error"))
    none = F.lit(None).cast("string")
    flat = F.array(step([], none), step([0], F.when(k % 3 == 0, "outer")), step([0, 0], F.when(k % 2 == 0, "inner")), step([0, 0, 2], none), step([1], none))
    traces = o.select(k.alias("tx_hash"), F.explode(flat).alias("t")).select("tx_hash", "t.*")
    return parse_evm.parity_errors(traces).select(F.col("tx_hash").alias("tx"), F.array_join(F.col("trace_address").cast("array<string>"), ",").alias("trace_address"), "inherited")


def bitcoin_raw(spark, d) -> DataFrame:
    line = table(spark, d, "lineitem")
    script = F.struct(F.when(F.col("l_linenumber") % 5 == 0, "nulldata").when(F.col("l_linenumber") % 5 == 1, "multisig").otherwise("pubkeyhash").alias("type"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("a"), F.col("l_suppkey").cast("string"))).alias("address"), F.array(F.concat(F.lit("b"), F.col("l_suppkey").cast("string"))).alias("addresses"))
    out = F.struct(F.col("l_extendedprice").alias("value"), F.col("l_linenumber").alias("n"), script.alias("scriptPubKey"))
    vin = F.struct(F.when(F.col("l_linenumber") != 1, F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("txid"), F.when(F.col("l_linenumber") != 1, F.col("l_suppkey")).alias("vout"))
    tx = F.struct(F.concat(F.lit("t"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_partkey").cast("string")).alias("txid"), F.array(vin).alias("vin"), F.array(out).alias("vout"))
    txs = line.groupBy("l_orderkey").agg(F.collect_list(tx).alias("tx"))
    block = F.struct(F.md5(F.col("l_orderkey").cast("string")).alias("hash"), F.col("l_orderkey").alias("height"), F.lit(1231006505).alias("time"), F.lit(2.5).alias("difficulty"), "tx")
    return txs.select(F.to_json(block).alias("payload"))


_BTC_TX = "'t' || l_orderkey || '-' || l_linenumber || '-' || l_partkey"


@query(f"SELECT l_orderkey AS height, {_BTC_TX} AS tx, l_linenumber AS n, CAST(round(l_extendedprice * 100000000) AS BIGINT) AS value, CASE WHEN l_linenumber % 5 = 0 THEN 'OP_RETURN' WHEN l_linenumber % 5 = 1 THEN NULL WHEN l_linenumber % 2 = 0 THEN 'a' || l_suppkey ELSE 'b' || l_suppkey END AS address FROM lineitem", plain=True)
def x14_bitcoin_outputs(spark, d):
    return parse_other.bitcoin_outputs(parse_other.bitcoin_blocks(bitcoin_raw(spark, d)))


@query(f"SELECT l_orderkey AS height, {_BTC_TX} AS tx, 0 AS i, 'p' || l_partkey AS prev_tx, l_suppkey AS prev_n FROM lineitem WHERE l_linenumber <> 1", plain=True)
def n10_bitcoin_inputs(spark, d):
    return parse_other.bitcoin_inputs(parse_other.bitcoin_blocks(bitcoin_raw(spark, d)))


_PROGRAM = "CASE l_linenumber % 6 WHEN 0 THEN 'system' WHEN 1 THEN 'stake' WHEN 2 THEN 'vote' WHEN 3 THEN 'spl-memo' WHEN 4 THEN 'spl-token' ELSE 'mystery' END"
_TYPE = "CASE l_linenumber % 6 WHEN 0 THEN 'transfer' WHEN 1 THEN 'delegate' WHEN 2 THEN 'withdraw' WHEN 3 THEN NULL WHEN 4 THEN 'burn' ELSE 'x' END"


def solana_raw(spark, d) -> DataFrame:
    info = F.struct(F.concat(F.lit("s"), F.col("l_partkey").cast("string")).alias("source"), F.concat(F.lit("v"), F.col("l_partkey").cast("string")).alias("voteAccount"), F.concat(F.lit("d"), F.col("l_suppkey").cast("string")).alias("destination"), F.col("l_partkey").alias("lamports"))
    line = table(spark, d, "lineitem").withColumn("program", F.expr(_PROGRAM)).withColumn("type", F.expr(_TYPE))
    parsed = F.when(F.col("program") == "spl-memo", F.to_json(F.struct("program", F.concat(F.lit("memo "), F.col("l_partkey").cast("string")).alias("parsed")))).otherwise(F.to_json(F.struct("program", F.struct("type", info.alias("info")).alias("parsed"))))
    return line.select(_md5(F.col("l_orderkey"), F.col("l_suppkey")).alias("tx"), F.col("l_linenumber").alias("i"), parsed.alias("instruction"))


@query(
    f"SELECT md5(l_orderkey || '-' || l_suppkey) AS tx, l_linenumber AS i, {_PROGRAM} AS program, CASE l_linenumber % 6 WHEN 0 THEN 'transfer' WHEN 1 THEN 'delegate' WHEN 2 THEN 'withdraw' WHEN 3 THEN 'MEMO' ELSE 'UNKNOWN' END AS kind, CASE l_linenumber % 6 WHEN 0 THEN 's' || l_partkey WHEN 2 THEN 'v' || l_partkey END AS source, CASE WHEN l_linenumber % 6 IN (0, 2) THEN 'd' || l_suppkey END AS destination, CASE WHEN l_linenumber % 6 IN (0, 2) THEN l_partkey END AS lamports, CASE WHEN l_linenumber % 6 = 3 THEN 'memo ' || l_partkey END AS memo, l_linenumber % 6 NOT IN (0, 1, 2) AS third_party, CASE WHEN l_linenumber % 6 = 5 THEN 'unknown program mystery' END AS parse_error FROM lineitem",
    plain=True,
)
def x17_solana_instructions(spark, d):
    return parse_other.solana_instructions(solana_raw(spark, d))


@query(
    "SELECT tx, i * 2 + side AS op_index, CASE WHEN side = 1 THEN 'd' || l_suppkey WHEN i % 6 = 0 THEN 's' || l_partkey ELSE 'v' || l_partkey END AS account, CASE side WHEN 0 THEN -l_partkey ELSE l_partkey END AS amount FROM (SELECT md5(l_orderkey || '-' || l_suppkey) AS tx, l_linenumber AS i, l_partkey, l_suppkey, bool_or(l_linenumber % 6 NOT IN (0, 1, 2)) OVER (PARTITION BY l_orderkey, l_suppkey) AS third FROM lineitem), (SELECT unnest([0, 1]) AS side) WHERE NOT third AND i % 6 IN (0, 2)",
    plain=True,
)
def l12_solana_ops(spark, d):
    return parse_other.solana_native_ops(parse_other.solana_instructions(solana_raw(spark, d)))


@query(
    "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'USER' WHEN 1 THEN 'BLOCK_METADATA' WHEN 2 THEN 'VALIDATOR' END AS kind, o_orderkey AS version, o_custkey % 2 = 0 AS success, make_timestamp(o_custkey * 1000000) AS ts, CASE WHEN o_orderkey % 4 = 0 THEN 'c' || o_custkey END AS module_name, CASE WHEN o_orderkey % 4 = 0 THEN 'transfer' END AS function_name, CASE WHEN o_orderkey % 4 = 3 THEN 'unknown transaction odd_transaction' END AS parse_error FROM orders",
    plain=True,
)
def x20_aptos_transactions(spark, d):
    o = table(spark, d, "orders")
    n = F.col("o_orderkey") % 4
    function = F.when(n == 0, F.concat(F.lit("0x1::c"), F.col("o_custkey").cast("string"), F.lit("::transfer")))
    payload = F.struct(F.when(n == 0, "entry_function_payload").alias("type"), function.alias("function"))
    kind = F.when(n == 0, "user_transaction").when(n == 1, "block_metadata_transaction").when(n == 2, "validator_transaction").otherwise("odd_transaction")
    tx = F.struct(kind.alias("type"), F.col("o_orderkey").cast("string").alias("version"), (F.col("o_custkey") % 2 == 0).alias("success"), (F.col("o_custkey") * 1000000 + 123).cast("string").alias("timestamp"), payload.alias("payload"))
    return parse_other.aptos_transactions(o.select("o_orderkey", F.to_json(tx).alias("transaction"))).select("o_orderkey", "kind", "version", "success", "ts", "module_name", "function_name", "parse_error")


@query(
    "SELECT o_orderkey AS slot, CAST(floor(o_orderkey / 32) AS BIGINT) AS epoch, ['phase0', 'altair', 'bellatrix', 'capella', 'deneb', 'future'][1 + k] AS version, o_custkey AS proposer_index, CASE WHEN k IN (2, 3, 4) THEN o_orderkey + 5 END AS execution_block_number, CASE WHEN k IN (3, 4) THEN 2 END AS n_withdrawals, CASE WHEN k = 4 THEN 1 END AS n_blobs, CASE WHEN o_orderkey % 50 = 0 THEN 'another slot' WHEN k = 5 THEN 'unknown version' END AS parse_error FROM (SELECT *, o_orderkey % 6 AS k FROM orders)",
    plain=True,
)
def x22_beacon_blocks(spark, d):
    o = table(spark, d, "orders")
    k = (F.col("o_orderkey") % 6).cast("int")
    version = F.get(F.array(*[F.lit(x) for x in [*parse_other.BEACON_VERSIONS, "future"]]), k)
    slot = F.when(F.col("o_orderkey") % 50 == 0, F.col("o_orderkey") + 1).otherwise(F.col("o_orderkey"))
    header = F.to_json(F.struct(F.struct(F.lit("r").alias("root"), F.struct(F.struct(slot.cast("string").alias("slot"), F.col("o_custkey").cast("string").alias("proposer_index")).alias("message")).alias("header")).alias("data")))
    payload = F.struct((F.col("o_orderkey") + 5).cast("string").alias("block_number"), F.array(F.lit("w1"), F.lit("w2")).alias("withdrawals"))
    body = F.struct(payload.alias("execution_payload"), F.array(F.lit("0xc")).alias("blob_kzg_commitments"))
    block = F.to_json(F.struct(version.alias("version"), F.struct(F.struct(body.alias("body")).alias("message")).alias("data")))
    raw = o.select(F.col("o_orderkey").alias("slot"), F.lit("r").alias("root"), header.alias("header"), block.alias("block"))
    return parse_other.beacon_blocks(raw).select("slot", "epoch", "version", "proposer_index", "execution_block_number", "n_withdrawals", "n_blobs", "parse_error")


@query("SELECT l_orderkey AS height, md5(CAST(l_orderkey AS VARCHAR)) AS block_hash, l_linenumber AS op_index, 'a' || l_partkey AS account, CAST(l_suppkey AS VARCHAR) || '000000000000000000000000000000000000000000' AS value FROM lineitem", plain=True)
def x23_rosetta_ops(spark, d):
    op = F.struct(F.struct(F.col("l_linenumber").alias("index")).alias("operation_identifier"), F.lit("TRANSFER").alias("type"), F.struct(F.concat(F.lit("a"), F.col("l_partkey").cast("string")).alias("address")).alias("account"), F.struct(F.concat(F.col("l_suppkey").cast("string"), F.lit("0" * 42)).alias("value")).alias("amount"))
    ops = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(op).alias("operations"))
    tx = F.array(F.struct(F.struct(F.lit("t").alias("hash")).alias("transaction_identifier"), "operations"))
    block = F.struct(F.struct(F.col("l_orderkey").alias("index"), F.md5(F.col("l_orderkey").cast("string")).alias("hash")).alias("block_identifier"), F.lit(1500000000123).alias("timestamp"), tx.alias("transactions"))
    return parse_other.rosetta_ops(ops.select(F.to_json(F.struct(block.alias("block"))).alias("payload"))).select("height", "block_hash", "op_index", "account", "value")


@query(
    "SELECT tx_hash, CAST(row_number() OVER (PARTITION BY tx_hash ORDER BY k) - 1 AS INTEGER) AS op_index, type, account, CAST(amount AS VARCHAR) AS amount FROM (SELECT md5(o_orderkey || 'tx') AS tx_hash, unnest([0, 1, 2, 3]) AS k, unnest(CASE WHEN dep THEN ['MINT', 'x', 'x', 'x'] ELSE ['FEE', 'FEE', 'FEE', 'FEE'] END) AS type, unnest(['c' || o_custkey, 'sequencer', 'base_vault', 'data_vault']) AS account, unnest(CASE WHEN dep THEN [o_custkey % 4, 0, 0, 0] ELSE [-(g * p + l), g * p - g * b, g * b, l] END) AS amount FROM (SELECT *, o_orderkey % 5 = 0 AS dep, 21000 + o_orderkey AS g, 30 + o_custkey % 70 AS p, o_custkey % 25 AS b, o_custkey % 3 AS l FROM orders)) WHERE amount <> 0",
    plain=True,
)
def l7_rollup_fee_ops(spark, d):
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    tx = table(spark, d, "orders").select(F.md5(F.concat(key.cast("string"), F.lit("tx"))).alias("tx_hash"), F.concat(F.lit("c"), who.cast("string")).alias("sender"), F.when(key % 5 == 0, 126).otherwise(2).alias("type"), (F.lit(21000) + key).alias("gas_used"), (30 + who % 70).alias("effective_gas_price"), (who % 25).alias("base_fee"), (who % 3).alias("l1_fee"), (who % 4).alias("mint"))
    return ledger.base_fee_ops(tx).withColumn("amount", F.col("amount").cast("string"))


@query(
    "SELECT md5(l_orderkey || '-' || l_partkey) AS tx_hash, l_linenumber * 2 + side AS op_index, 't' || l_suppkey % 3 AS token, CASE WHEN l_returnflag = 'R' THEN 'FAILURE' ELSE 'SUCCESS' END AS status, CASE side WHEN 0 THEN 'a' || l_partkey ELSE 'b' || l_suppkey END AS account, CASE side WHEN 0 THEN -v ELSE v END AS amount FROM (SELECT *, CAST(l_quantity AS BIGINT) - 5 AS v FROM lineitem), (SELECT unnest([0, 1]) AS side) WHERE v > 0",
    plain=True,
)
def l9_transfer_ops(spark, d):
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    t = table(spark, d, "lineitem").select(_md5(F.col("l_orderkey"), F.col("l_partkey")).alias("tx_hash"), F.col("l_linenumber").alias("log_index"), text("t", F.col("l_suppkey") % 3).alias("token"), text("a", F.col("l_partkey")).alias("from_address"), text("b", F.col("l_suppkey")).alias("to_address"), (F.col("l_quantity").cast("bigint") - 5).alias("value"), (F.col("l_returnflag") != "R").alias("succeeded"))
    return ledger.transfer_ops(t)


@query(
    "SELECT l_orderkey AS tx_hash, l_suppkey AS account, -sum(amount) AS amount, CASE WHEN sum(amount) > 0 THEN 'DESTRUCT' ELSE 'ERROR' END AS type FROM (SELECT l_orderkey, l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT) - 20 AS amount, min(CASE WHEN l_returnflag = 'A' THEN l_linenumber END) OVER (PARTITION BY l_orderkey, l_suppkey) AS f FROM lineitem) WHERE l_linenumber > f GROUP BY 1, 2 HAVING sum(amount) <> 0",
    plain=True,
)
def l2_destroyed_accounts(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("tx_hash"), F.col("l_linenumber").alias("op_index"), F.col("l_suppkey").alias("account"), (F.col("l_quantity").cast("bigint") - 20).alias("amount"), F.lit("SUCCESS").alias("status"), "l_returnflag")
    return ledger.destroyed(line, line.where("l_returnflag = 'A'").select("tx_hash", "account", "op_index"))


@query("SELECT CAST(CASE WHEN p < 1 THEN 0 WHEN p < 3 THEN 1 ELSE 2 END AS INTEGER) AS endpoint, count(*) AS n FROM (SELECT CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 6 AS p FROM orders) GROUP BY 1", plain=True)
def s18_weighted_pick(spark, d):
    """Heights that each endpoint gets."""
    picks = table(spark, d, "orders").select(S.weighted_pick("o_orderkey", [1, 2, 3]).alias("endpoint"))
    return picks.groupBy("endpoint").agg(F.count("*").alias("n"))


@query(
    "WITH RECURSIVE v AS (SELECT o_custkey, list(o_orderkey % 11 ORDER BY o_orderkey) AS xs FROM orders GROUP BY 1), s AS (SELECT o_custkey, xs, 1 AS i, CAST(xs[1] AS DOUBLE) AS a, CASE WHEN xs[1] > 5 THEN 1 ELSE 0 END AS h FROM v UNION ALL SELECT o_custkey, xs, i + 1, a + (xs[i + 1] - a) * (2.0::DOUBLE / 11), least(3, greatest(0, h + CASE WHEN xs[i + 1] > 5 THEN 1 ELSE -1 END)) FROM s WHERE i < len(xs)) SELECT o_custkey, CAST(round(a * 1000) AS BIGINT) AS average, h AS violations FROM s WHERE i = len(xs)",
    plain=True,
)
def s20_v10_moving_average_and_hysteresis(spark, d):
    values = table(spark, d, "orders").groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey"))), lambda x: x["o_orderkey"] % 11).alias("xs"))
    return values.select("o_custkey", F.round(S.moving_average("xs") * 1000).cast("bigint").alias("average"), S.hysteresis(F.transform("xs", lambda x: x > 5), 3).alias("violations"))


@query("SELECT o_orderkey, array_to_string(list_transform(string_split(lower(replace(o_orderpriority, ' ', '-')), '-'), lambda x: upper(x[1]) || x[2:]), '') AS name FROM orders", plain=True)
def s16_camel_case(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.camel_case(F.regexp_replace("o_orderpriority", "[- ]", "_")).alias("name"))


@query("SELECT method, 'chain.Api' AS service, count(*) AS n FROM (SELECT event_type AS method FROM events) GROUP BY 1", plain=True)
def q19_method_names(spark, d):
    m = table(spark, d, "events").select(S.method_name(F.concat(F.lit("/chain.Api/"), "event_type")).alias("m"))
    return m.groupBy("m.method", "m.service").agg(F.count("*").alias("n"))


@query("SELECT height, hash, skipped FROM (SELECT height, CASE WHEN height % 3 = 0 AND NOT skipped THEN hash || 'p' ELSE hash END AS hash, skipped FROM canonical WHERE height % 10 <> 0 UNION ALL SELECT height, hash, skipped FROM canonical WHERE height % 10 = 0)")
def f9_primary_or_secondary(spark, d):
    blocks = reads.canonical_blocks(derived.block_writes(spark, d)).select("height", "hash", "skipped")
    primary = blocks.where("height % 10 != 0").withColumn("hash", F.when((F.col("height") % 3 == 0) & ~F.col("skipped"), F.concat("hash", F.lit("p"))).otherwise(F.col("hash")))
    return reorg.primary_or_secondary(primary, blocks, ["height"])


@query("SELECT height, hash FROM canonical WHERE NOT skipped AND height > 300 AND height <= (SELECT max(height) - 12 FROM canonical)")
def st7_confirmed_batch(spark, d):
    from chainloom.streaming.events import confirmed

    blocks = reads.canonical_blocks(derived.block_writes(spark, d)).where(~F.col("skipped"))
    top = reads.canonical_blocks(derived.block_writes(spark, d)).agg(F.max("height")).first()[0]
    return confirmed(blocks, top, 12, 300, top).select("height", "hash")


@query("SELECT event_id, event_type, e.height, parent_height FROM events0 e LEFT JOIN (SELECT height, hash, parent_height FROM canonical WHERE NOT skipped) c ON e.height = c.height AND e.hash = c.hash")
def st4_enriched_events(spark, d):
    blocks = reads.canonical_blocks(derived.block_writes(spark, d)).where(~F.col("skipped")).select("height", "hash", "parent_height")
    return derived.chain_events(spark, d).join(blocks, ["height", "hash"], "left").select("event_id", "event_type", "height", "parent_height")


@query("SELECT topic, retries, count(*) AS n FROM (SELECT event_type AS topic, CAST(event_id % 3 AS INTEGER) AS retries FROM events WHERE event_id % 7 <> 0) GROUP BY 1, 2", plain=True)
def w7_messages(spark, d):
    """Latest states of messages that were sent, sent again and deleted, in the form a store keeps them."""
    e = table(spark, d, "events").select("event_id", "event_type")
    states = e.withColumn("retries", F.explode(F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int")))).select("event_id", "event_type", "retries", F.lit(False).alias("deleted"), F.col("retries").alias("write_seq"))
    gone = e.where("event_id % 7 = 0").select("event_id", "event_type", F.lit(0).alias("retries"), F.lit(True).alias("deleted"), F.lit(9).alias("write_seq"))
    last = continuity.versions_as_of(states.unionByName(gone), "event_id", "write_seq", 100)
    return last.where(~F.col("deleted")).groupBy(F.col("event_type").alias("topic"), "retries").agg(F.count("*").alias("n"))

PREPARED["x6_flat_traces"] = (trace_raw, _flat)

from chainloom.plans import blocks  # noqa: E402, F401 - registers more queries
