"""Do blocks and events follow one another?  Violations come as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainloom.errors import Discontinuous
from chainloom.operators.ordered import BUCKET, with_previous


def chain_faults(blocks: DataFrame, last_block=None, bucket: int = BUCKET) -> DataFrame:
    """Blocks with ``fault``: whether they don't follow the last block before them that isn't skipped, and ``previous``.

    A parent hash must be that block's hash, and a parent height other than 0 its height;
    an empty parent hash is not checked.  ``last_block``: (height, hash) before the first.
    Skipped blocks have no fault.
    """
    before = None if last_block is None else F.struct(F.lit(last_block[0]).cast("bigint").alias("height"), F.lit(last_block[1]).alias("hash"))
    keys = ["tag"] if "tag" in blocks.columns else []
    seen = with_previous(blocks.where(~F.col("skipped")), "height", ["height", "hash"], keys, bucket=bucket, before=before)
    hash_off = F.col("parent_hash") != F.col("previous.hash")
    height_off = (F.col("parent_height") != 0) & (F.col("parent_height") != F.col("previous.height"))
    fault = F.col("previous").isNotNull() & (F.col("parent_hash") != "") & (hash_off | height_off)
    skipped = blocks.where("skipped").withColumn("previous", F.lit(None).cast(seen.schema["previous"].dataType)).withColumn("fault", F.lit(False))
    return seen.withColumn("fault", F.coalesce(fault, F.lit(False))).unionByName(skipped)


def validate_chain(blocks: DataFrame, last_block=None, bucket: int = BUCKET) -> DataFrame:
    """Blocks that don't follow the last block before them that isn't skipped."""
    keys = ["tag"] if "tag" in blocks.columns else []
    bad = chain_faults(blocks.where(~F.col("skipped")), last_block, bucket).where("fault")
    return bad.select(*keys, "height", "hash", "parent_hash", F.col("previous.hash").alias("expected_parent_hash"))


def assert_chain(blocks: DataFrame, last_block=None) -> DataFrame:
    found = validate_chain(blocks, last_block).take(1)
    if found:
        raise Discontinuous(f"block {found[0]['height']} doesn't follow its predecessor")
    return blocks


def validate_event_ids(events: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Events whose id isn't one more than that before."""
    seen = with_previous(events.select("event_tag", "event_id"), "event_id", ["event_id"], ["event_tag"], bucket=bucket)
    return seen.where(F.col("event_id") != F.col("previous.event_id") + 1).select("event_tag", "event_id", F.col("previous.event_id").alias("previous_event_id"))


def validate_event_pairs(events: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Neighbouring events that don't fit: what may follow depends on both types.

    Two added blocks, or two removed ones, must be neighbours in the chain; a removal must
    take the block just added; an addition after a removal must be of that height.
    """
    cols = ["event_id", "event_type", "height", "hash", "parent_hash", "skipped"]
    seen = with_previous(events, "event_id", cols, ["event_tag"], bucket=bucket).where("previous is not null")
    p = lambda c: F.col(f"previous.{c}")
    links = lambda upper_parent, lower_hash, upper_skip, lower_skip: upper_skip | lower_skip | (upper_parent == "") | (upper_parent == lower_hash)
    added, removed = F.col("event_type") == "BLOCK_ADDED", F.col("event_type") == "BLOCK_REMOVED"
    was_added = p("event_type") == "BLOCK_ADDED"
    fits = (
        F.when(added & was_added, (F.col("height") == p("height") + 1) & links(F.col("parent_hash"), p("hash"), F.col("skipped"), p("skipped")))
        .when(removed & ~was_added, (p("height") == F.col("height") + 1) & links(p("parent_hash"), F.col("hash"), p("skipped"), F.col("skipped")))
        .when(removed & was_added, (F.col("height") == p("height")) & F.col("hash").eqNullSafe(p("hash")))
        .otherwise(F.col("height") == p("height"))
    )
    return seen.where(~F.coalesce(fits, F.lit(False))).select("event_tag", "event_id", "event_type", "height")


def canonical_from_events(events: DataFrame, as_of: int | None = None) -> DataFrame:
    """The chain that a log of events leaves: the last event of each height, if it adds a block.

    Every removal stands before what replaces it, so no fold over the log is needed.
    """
    seen = events if as_of is None else events.where(F.col("event_id") <= as_of)
    last = seen.groupBy("event_tag", "height").agg(F.max_by(F.struct("event_id", "event_type", "tag", "hash", "parent_hash", "skipped"), "event_id").alias("last"))
    return last.where("last.event_type = 'BLOCK_ADDED'").select("event_tag", "height", "last.event_id", "last.tag", "last.hash", "last.parent_hash", "last.skipped")


def versions_as_of(versions: DataFrame, key: str, sequence: str, checkpoint: int) -> DataFrame:
    """The latest version of each key at a checkpoint."""
    others = [c for c in versions.columns if c != key]
    top = versions.where(F.col(sequence) <= checkpoint).groupBy(key).agg(F.max_by(F.struct(*others), sequence).alias("top"))
    return top.select(key, "top.*")


def trim_trailing_skipped(blocks: DataFrame) -> DataFrame:
    """Without the skipped blocks above the last real one."""
    last = blocks.where(~F.col("skipped")).agg(F.max("height").alias("last"))
    return blocks.join(F.broadcast(last), F.col("height") <= F.col("last")).drop("last")


def descends_from(blocks: DataFrame, fork_hash: str) -> bool:
    """Whether the first block that isn't skipped has the fork block for a parent; a batch of skipped ones does."""
    first = blocks.where(~F.col("skipped")).agg(F.min_by("parent_hash", "height").alias("p")).first()
    return first["p"] in (None, "", fork_hash)


def reorg_distance(forks: DataFrame, irreversible: int) -> DataFrame:
    """Result of each reorg's distance; 0 switches the check off, and nothing is ever stopped by it."""
    far = (F.col("distance") >= irreversible) & F.lit(irreversible > 0)
    return forks.withColumn("result", F.when(far, "error").otherwise("success"))


def rank_versions(versions: DataFrame, key: str, sequence: str) -> DataFrame:
    """Versions of each key, newest first."""
    return versions.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(sequence))))
