"""Parity checks, monitors and liveness, as counts of what is off."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPARED = ["tag", "hash", "parent_hash", "parent_height", "skipped", "block_ts"]


def compare_blocks(expected: DataFrame, actual: DataFrame, columns: list[str] = COMPARED) -> DataFrame:
    """Heights where two tables of blocks differ, and in what."""
    a = expected.select("height", F.struct(*columns).alias("a"))
    b = actual.select("height", F.struct(*columns).alias("b"))
    both = a.join(b, "height", "full_outer")
    reasons = F.array_compact(
        F.array(F.when(F.col("a").isNull(), "unexpected"), F.when(F.col("b").isNull(), "missing"), *[F.when(F.col("a").isNotNull() & F.col("b").isNotNull() & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c) for c in columns])
    )
    return both.select("height", F.array_join(reasons, ",").alias("differences")).where("differences != ''")


def monitor_counts(node: DataFrame, stored: DataFrame, start: int, end: int) -> DataFrame:
    """Over the closed range [start, end]: how many heights are checked, equal, missing and different, by reason."""
    inside = F.col("height").between(start, end)
    found = compare_blocks(node.where(inside), stored.where(inside))
    return found.groupBy("differences").agg(F.count("*").alias("n"))


def sampled_heights(blocks: DataFrame, percent: int) -> DataFrame:
    """About ``percent`` of a hundred heights, the same on every run; for cross validation against a second node."""
    return blocks.where(F.pmod(F.crc32(F.col("height").cast("string")), F.lit(100)) < percent)


def event_gaps(events: DataFrame, expected_from: int = 1) -> DataFrame:
    """Of each stream: events, ids missing below its last, and repeated ids."""
    of = events.groupBy("event_tag").agg(F.count("*").alias("n"), F.max("event_id").alias("last"), F.count_distinct("event_id").alias("ids"))
    return of.select("event_tag", "n", (F.col("last") - expected_from + 1 - F.col("ids")).alias("missing"), (F.col("n") - F.col("ids")).alias("repeated"))


def ledger_residuals(ops: DataFrame) -> DataFrame:
    """Heights whose successful operations don't sum to zero."""
    return ops.where("status = 'SUCCESS'").groupBy("height").agg(F.sum("amount").alias("residual")).where("residual != 0")


def liveness(tips: DataFrame, now, threshold_s: int) -> DataFrame:
    """Chains whose last block is older than the threshold at ``now`` (a column or timestamp)."""
    age = F.unix_timestamp(F.lit(now)) - F.unix_timestamp("last_ts")
    return tips.withColumn("age_s", age).withColumn("late", F.col("age_s") > threshold_s)


def service_level(delta, limit: int):
    """success or error of a distance against its limit."""
    return F.when(delta <= limit, "success").otherwise("error")


def canary(tips: DataFrame, height_limit: int, time_limit_s: int) -> DataFrame:
    """One row per chain of node and stored tips: their distances and whether each keeps its limit.

    ``tips``: chain, node_height, stored_height, event_height, node_ts, stored_ts.
    """
    block, event = F.col("node_height") - F.col("stored_height"), F.col("stored_height") - F.col("event_height")
    seconds = F.unix_timestamp("node_ts") - F.unix_timestamp("stored_ts")
    return tips.select("chain", block.alias("block_height_delta"), event.alias("event_height_delta"), seconds.alias("time_delta_s"), service_level(block, height_limit).alias("block_height_sla"), service_level(event, height_limit).alias("event_height_sla"), service_level(seconds, time_limit_s).alias("time_sla"))


def missing_workflows(expected: DataFrame, running: DataFrame) -> DataFrame:
    return expected.join(running.select("workflow_id"), "workflow_id", "left_anti")


def polling_canary(writes: DataFrame, watermarks: DataFrame, events: DataFrame, index: DataFrame, tag: int, size: int) -> DataFrame:
    """(api, n, ok): what the read operators answer over the last ``size`` heights, each asked once.

    One row of each answer's count; ok where it is what the range and the tip imply.
    """
    from chainloom.operators import reads

    tip = reads.tip_height(watermarks, tag)
    low, last = max(tip - size + 1, 0), reads.last_event(events).agg(F.max("max_event_id")).first()[0] or 0
    span = tip - low + 1
    asked = {
        "latest_block": (reads.latest_block(watermarks, tag), 1),
        "block_by_height": (reads.block_by_height(writes, tag, tip), 1),
        "blocks_by_range": (reads.blocks_by_range(writes, tag, low, tip + 1), span),
        "block_files": (reads.blocks_by_range(writes, tag, low, tip + 1).where("hash is not null or skipped"), span),
        "event_by_id": (reads.event_by_id(events, last, last), 1),
        "events_after": (reads.events_after(events, last - min(size, last), size, last), min(size, last)),
        "first_event_of_height": (reads.first_event_of_height(events, low), 1),
        "blocks_of_transactions": (reads.blocks_of_transactions(index.where(F.col("block_number").between(low, tip)), writes.where(F.col("height").between(low, tip))), None),
    }
    rows = None
    for api, (found, n) in asked.items():
        row = found.agg(F.count("*").alias("n")).select(F.lit(api).alias("api"), "n", (F.col("n") >= 0 if n is None else F.col("n") == n).alias("ok"))
        rows = row if rows is None else rows.unionByName(row)
    return rows


def streaming_canary(events: DataFrame, n: int = 4, back: int = 2) -> DataFrame:
    """The ``n`` events of each stream from ``back`` before its last on, as far as there are any."""
    last = events.groupBy("event_tag").agg(F.max("event_id").alias("_last"))
    met = events.join(F.broadcast(last), "event_tag")  # a row per stream
    return met.where((F.col("event_id") > F.col("_last") - back - 1) & (F.col("event_id") <= F.col("_last") - back - 1 + n)).drop("_last")


def method_counters(calls: DataFrame, expected: list[str] = ()) -> DataFrame:
    """Of each method: calls that went well, calls that failed, and the mean milliseconds.  ``calls``: method, error (null: none), ms; errors that are ``expected`` count as well."""
    well = F.col("error").isNull() | F.col("error").isin(*expected) if expected else F.col("error").isNull()
    return calls.groupBy("method").agg(F.count_if(well).alias("successes"), F.count_if(~well).alias("errors"), F.avg("ms").alias("mean_ms"))
