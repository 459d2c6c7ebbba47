"""Chain tables made from the test tables, by rules that SQL can state too.

``SQL`` holds the same rules as common table expressions, for the oracle.  Every rule is a
row-wise expression (no window), so the tables read at any scale as fast as their source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows by key over all shuffle partitions: what is made of them is far larger, so their own size must not put them together in few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _skipped(h):
    return F.pmod(h, F.lit(17)) == 5


def _previous(h):
    """The last height before h that isn't skipped."""
    return h - 1 - F.when(_skipped(h - 1), 1).otherwise(0)


def block_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every write of block metadata: each height once, and before it a stale write of some heights."""
    h = F.col("o_orderkey")
    base = table(spark, sf_dir, "orders").select(
        F.lit(1).alias("tag"),
        h.alias("height"),
        _skipped(h).alias("skipped"),
        F.when(~_skipped(h), F.md5(h.cast("string"))).alias("hash"),
        F.when(_skipped(h), F.lit(None)).when(h == 0, "").otherwise(F.md5(_previous(h).cast("string"))).alias("parent_hash"),
        F.when(_skipped(h), F.lit(None)).when(h == 0, F.lit(0)).otherwise(_previous(h)).cast("bigint").alias("parent_height"),
        F.col("o_orderdate").alias("block_ts"),
    )
    now = base.withColumn("write_seq", F.col("height") * 2 + 1)
    stale = base.where("height % 50 = 7 and not skipped").withColumn("hash", F.md5(F.concat(F.col("height").cast("string"), F.lit("-stale")))).withColumn("write_seq", F.col("height") * 2)
    return now.unionByName(stale)


def watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes of the tip: moved forward every 100 heights, and once back at the end."""
    w = table(spark, sf_dir, "orders").where("o_orderkey % 100 = 99")
    moved = w.select(F.lit(1).alias("tag"), F.col("o_orderkey").alias("height"), F.col("o_orderkey").alias("write_seq"))
    back = w.agg(F.max("o_orderkey").alias("m")).select(F.lit(1).alias("tag"), (F.col("m") - 37).alias("height"), (F.col("m") + 1).alias("write_seq"))
    return moved.unionByName(back)


def chain_events(spark: SparkSession, sf_dir: str, event_tag: int = 0) -> DataFrame:
    """Added and removed blocks: heights 13 of each 34 are added, removed (twice in stream 1) and added anew."""
    extra = 2 if event_tag == 0 else 4
    h = F.col("height")
    reorg = h % 34 == 13
    blocks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("height"), F.col("o_orderdate").alias("block_ts"))
    steps = blocks.withColumn("k", F.explode(F.sequence(F.lit(0), F.when(reorg, extra).otherwise(0))))
    final = F.md5(h.cast("string"))
    return steps.select(
        F.lit(event_tag).alias("event_tag"),
        (1 + h + extra * F.floor((h + 20) / 34) + F.col("k")).cast("bigint").alias("event_id"),
        F.when(F.col("k") % 2 == 0, "BLOCK_ADDED").otherwise("BLOCK_REMOVED").alias("event_type"),
        F.lit(1).alias("tag"),
        "height",
        F.when(_skipped(h), F.lit(None)).when(reorg & (F.col("k") < extra), F.md5(F.concat(h.cast("string"), F.lit("-old")))).otherwise(final).alias("hash"),
        F.when(_skipped(h), F.lit(None)).when(h == 0, "").otherwise(F.md5(_previous(h).cast("string"))).alias("parent_hash"),
        _skipped(h).alias("skipped"),
        "block_ts",
    )


def tx_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions and the blocks they were in; one of 13 also in a block that was reorganised away."""
    line = table(spark, sf_dir, "lineitem").select(
        F.md5(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))).alias("tx_hash"),
        F.col("l_orderkey").alias("block_number"),
        "l_partkey",
    )
    real = line.select(F.lit(1).alias("tag"), "tx_hash", "block_number", F.md5(F.col("block_number").cast("string")).alias("block_hash"))
    orphan = line.where("l_partkey % 13 = 0").select(F.lit(1).alias("tag"), "tx_hash", "block_number", F.md5(F.concat(F.col("block_number").cast("string"), F.lit("-orphan"))).alias("block_hash"))
    return real.unionByName(orphan).distinct()


def packed_tx_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tx_index`` by block, with the list of its transactions; lines are gathered as numbers and named after the shuffle."""
    line = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey").groupBy("l_orderkey").agg(F.collect_set(F.struct("l_linenumber", "l_partkey")).alias("rows"))
    name = lambda r: F.md5(F.concat_ws("-", F.col("l_orderkey").cast("string"), r["l_linenumber"].cast("string"), r["l_partkey"].cast("string")))
    block = lambda rows, end: F.struct(F.md5(F.concat(F.col("l_orderkey").cast("string"), F.lit(end))).alias("block_hash"), F.transform(rows, name).alias("tx_hashes"))
    both = F.array(block(F.col("rows"), ""), block(F.filter("rows", lambda r: r["l_partkey"] % 13 == 0), "-orphan"))
    each = line.select(F.col("l_orderkey").alias("block_number"), F.explode(both).alias("b")).where(F.size("b.tx_hashes") > 0)
    return each.select(F.lit(1).alias("tag"), "block_number", "b.block_hash", "b.tx_hashes")


def ledger_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debits of customers and credits of suppliers in cents."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    joined = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", cents.alias("cents"), "l_returnflag").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    status = F.when(F.col("l_returnflag") == "R", "FAILURE").otherwise("SUCCESS")
    pair = F.explode(F.array(F.struct(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("account"), (-F.col("cents")).alias("amount")), F.struct(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("account"), F.col("cents").alias("amount"))))
    return joined.select("l_orderkey", status.alias("status"), pair.alias("op")).select(F.col("l_orderkey").alias("height"), "status", "op.account", "op.amount")


SQL = """WITH block_writes AS (
  SELECT 1 AS tag, o_orderkey AS height, o_orderkey % 17 = 5 AS skipped,
    CASE WHEN o_orderkey % 17 <> 5 THEN md5(CAST(o_orderkey AS VARCHAR)) END AS hash,
    CASE WHEN o_orderkey % 17 = 5 THEN NULL WHEN o_orderkey = 0 THEN '' ELSE md5(CAST(o_orderkey - 1 - CASE WHEN (o_orderkey - 1) % 17 = 5 THEN 1 ELSE 0 END AS VARCHAR)) END AS parent_hash,
    CASE WHEN o_orderkey % 17 = 5 THEN NULL WHEN o_orderkey = 0 THEN 0 ELSE o_orderkey - 1 - CASE WHEN (o_orderkey - 1) % 17 = 5 THEN 1 ELSE 0 END END AS parent_height,
    o_orderdate AS block_ts, o_orderkey * 2 + 1 AS write_seq FROM orders
  UNION ALL
  SELECT 1, o_orderkey, FALSE, md5(CAST(o_orderkey AS VARCHAR) || '-stale'),
    CASE WHEN o_orderkey = 0 THEN '' ELSE md5(CAST(o_orderkey - 1 - CASE WHEN (o_orderkey - 1) % 17 = 5 THEN 1 ELSE 0 END AS VARCHAR)) END,
    CASE WHEN o_orderkey = 0 THEN 0 ELSE o_orderkey - 1 - CASE WHEN (o_orderkey - 1) % 17 = 5 THEN 1 ELSE 0 END END,
    o_orderdate, o_orderkey * 2 FROM orders WHERE o_orderkey % 50 = 7 AND o_orderkey % 17 <> 5
), canonical AS (
  SELECT * FROM block_writes QUALIFY row_number() OVER (PARTITION BY tag, height ORDER BY write_seq DESC) = 1
), watermarks AS (
  SELECT 1 AS tag, o_orderkey AS height, o_orderkey AS write_seq FROM orders WHERE o_orderkey % 100 = 99
  UNION ALL SELECT 1, max(o_orderkey) - 37, max(o_orderkey) + 1 FROM orders WHERE o_orderkey % 100 = 99
), tip AS (
  SELECT tag, height FROM watermarks QUALIFY row_number() OVER (PARTITION BY tag ORDER BY write_seq DESC) = 1
), streams AS (SELECT 0 AS event_tag, 2 AS extra UNION ALL SELECT 1, 4
), all_events AS (
  SELECT event_tag, 1 + o_orderkey + extra * CAST(floor((o_orderkey + 20) / 34) AS BIGINT) + k AS event_id,
    CASE WHEN k % 2 = 0 THEN 'BLOCK_ADDED' ELSE 'BLOCK_REMOVED' END AS event_type, 1 AS tag, o_orderkey AS height,
    CASE WHEN o_orderkey % 17 = 5 THEN NULL WHEN o_orderkey % 34 = 13 AND k < extra THEN md5(CAST(o_orderkey AS VARCHAR) || '-old') ELSE md5(CAST(o_orderkey AS VARCHAR)) END AS hash,
    CASE WHEN o_orderkey % 17 = 5 THEN NULL WHEN o_orderkey = 0 THEN '' ELSE md5(CAST(o_orderkey - 1 - CASE WHEN (o_orderkey - 1) % 17 = 5 THEN 1 ELSE 0 END AS VARCHAR)) END AS parent_hash,
    o_orderkey % 17 = 5 AS skipped, o_orderdate AS block_ts
  FROM orders, streams, (SELECT unnest(range(5)) AS k) WHERE k <= CASE WHEN o_orderkey % 34 = 13 THEN extra ELSE 0 END
), events0 AS (SELECT * FROM all_events WHERE event_tag = 0
), events1 AS (SELECT * FROM all_events WHERE event_tag = 1
), tx_index AS (
  SELECT DISTINCT * FROM (
    SELECT 1 AS tag, md5(l_orderkey || '-' || l_linenumber || '-' || l_partkey) AS tx_hash, l_orderkey AS block_number, md5(CAST(l_orderkey AS VARCHAR)) AS block_hash FROM lineitem
    UNION ALL SELECT 1, md5(l_orderkey || '-' || l_linenumber || '-' || l_partkey), l_orderkey, md5(l_orderkey || '-orphan') FROM lineitem WHERE l_partkey % 13 = 0)
), ledger_ops AS (
  SELECT l_orderkey AS height, CASE WHEN l_returnflag = 'R' THEN 'FAILURE' ELSE 'SUCCESS' END AS status, 'c' || o_custkey AS account, -CAST(round(l_extendedprice * 100) AS BIGINT) AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'FAILURE' ELSE 'SUCCESS' END, 's' || l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)
"""
