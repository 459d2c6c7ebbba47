"""Forks and what follows from them, as joins on height."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.errors import Discontinuous, InvalidArgument, NotFound


def compare_branches(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Both branches by height: ``same`` is true where hashes agree, null where both are skipped or one is missing."""
    a = mine.select("height", F.col("hash").alias("my_hash"), F.col("skipped").alias("my_skip"))
    b = theirs.select("height", F.col("hash").alias("their_hash"), F.col("skipped").alias("their_skip"))
    both = a.join(b, "height", "full_outer")
    there = F.col("my_skip").isNotNull() & F.col("their_skip").isNotNull()
    same = F.when(there & ~(F.col("my_skip") & F.col("their_skip")), F.col("my_hash").eqNullSafe(F.col("their_hash")))
    return both.select("height", "my_hash", "their_hash", same.alias("same"))


def fork_height(mine: DataFrame, theirs: DataFrame, start_height: int = 0) -> DataFrame:
    """One row: the last height before the first mismatch where both agree (``fork_height``), and that mismatch (null: none).

    Two aggregations with partial results over one join, whatever the depth of the fork.
    """
    pairs = compare_branches(mine, theirs).where(F.col("height") >= start_height)
    first = pairs.agg(F.min(F.when(~F.col("same"), F.col("height"))).alias("mismatch_height"))
    before = pairs.where("same").select("height").crossJoin(F.broadcast(first)).where(F.col("mismatch_height").isNull() | (F.col("height") < F.col("mismatch_height")))  # one row on the right
    return before.groupBy("mismatch_height").agg(F.max("height").alias("fork_height")).select("fork_height", "mismatch_height")


def streamer_changes(events: DataFrame, canonical: DataFrame, event_tag: int, batch: int, start_height: int = 0) -> DataFrame:
    """Events that bring a stream up to the canonical chain, numbered on from its last.

    Blocks of the stream above the fork (the highest block both have) are removed, newest
    first; then up to ``batch`` canonical blocks above the fork are added.
    """
    from chainloom.operators.continuity import canonical_from_events

    mine = events.where(F.col("event_tag") == event_tag)
    held = canonical_from_events(mine)
    top = mine.agg(F.max("event_id").alias("m")).first()["m"]
    if top is None:
        fork, removed, top = start_height - 1, None, 0
    else:
        both = held.alias("h").join(canonical.alias("c"), "height").where(F.col("h.hash").eqNullSafe(F.col("c.hash")) & (F.col("h.skipped") == F.col("c.skipped")))
        fork = both.agg(F.max("height").alias("f")).first()["f"]
        if fork is None:
            raise Discontinuous("the stream and the chain have no block in common")
        removed = held.where(F.col("height") > fork).select(F.lit("BLOCK_REMOVED").alias("event_type"), "tag", "height", "hash", "parent_hash", "skipped", (-F.col("height")).alias("_at"))
    added = canonical.where((F.col("height") > fork) & (F.col("height") <= fork + batch)).select(
        F.lit("BLOCK_ADDED").alias("event_type"), "tag", "height", "hash", "parent_hash", "skipped", F.col("height").alias("_at")
    )
    return number_events(added if removed is None else removed.unionByName(added.withColumn("_at", F.col("height") + 1)), event_tag, top)


def number_events(events: DataFrame, event_tag: int, last_id: int) -> DataFrame:
    """Ids from ``last_id`` + 1 on in the order of ``_at`` (which is dropped)."""
    from chainloom.operators.ordered import running_number

    return running_number(events.withColumn("event_tag", F.lit(event_tag)), "_at", last_id + 1, "event_id").drop("_at")


def consensus(mine: DataFrame, theirs: DataFrame, latest: int, irreversible: int) -> DataFrame:
    """The last height that should be final and isn't skipped on both sides, and whether both agree on it."""
    final = latest - irreversible + 1
    pairs = compare_branches(mine.where(F.col("height") <= final), theirs.where(F.col("height") <= final)).where("same is not null")
    return pairs.groupBy().agg(F.max(F.struct("height", "same")).alias("top")).select(F.col("top.height").alias("height"), F.col("top.same").alias("agrees"))


def reconcile_events(events: DataFrame, blocks: DataFrame, new_event_tag: int) -> DataFrame:
    """Old events as events of blocks of another tag: other hashes become skipped blocks."""
    b = blocks.select("height", F.col("tag").alias("new_tag"), F.col("hash").alias("new_hash"))
    joined = events.join(b, "height")
    same = F.col("hash").eqNullSafe(F.col("new_hash"))
    return joined.select(F.lit(new_event_tag).alias("event_tag"), "event_id", "event_type", F.col("new_tag").alias("tag"), "height", F.when(same, F.col("hash")).alias("hash"), F.when(same, F.col("parent_hash")).alias("parent_hash"), (~same | F.col("skipped")).alias("skipped"))


def rehydrate(raw: DataFrame, old_tag: int, new_tag: int) -> DataFrame:
    """Payloads of one tag as payloads of a later one."""
    if old_tag >= new_tag:
        raise InvalidArgument("a block is copied to a later tag")
    return raw.where(F.col("tag") == old_tag).withColumn("tag", F.lit(new_tag))


def upgrade(raw: DataFrame, patches: DataFrame, old_tag: int, new_tag: int, column: str) -> DataFrame:
    """Payloads of a new tag with one part from ``patches`` (height, hash, part); those without one keep theirs."""
    if old_tag > new_tag:
        raise InvalidArgument("a block is upgraded to the same tag or a later one")
    p = patches.select("height", "hash", F.col(column).alias("_patch"))
    joined = raw.where(F.col("tag") == old_tag).join(p, ["height", "hash"], "left")
    return joined.withColumn("tag", F.lit(new_tag)).withColumn(column, F.coalesce("_patch", column)).drop("_patch")


def primary_or_secondary(primary: DataFrame, secondary: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the primary source, and of the secondary those that it lacks."""
    return primary.unionByName(secondary.join(primary.select(*keys), keys, "left_anti"))


def require_some(df: DataFrame, what: str) -> DataFrame:
    if not df.take(1):
        raise NotFound(what)
    return df
