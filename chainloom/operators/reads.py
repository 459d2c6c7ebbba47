"""Lookups over block, event and transaction tables.

A lookup is a filter that reaches the scan, or a join on a key list.  Checks that the
service does on a request (tags, ranges, the tip) raise errors; they look at one row of
the watermark table, resolved once per call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.config import LITERAL_ZERO, Chain
from chainloom.errors import FailedPrecondition, InvalidArgument, InvalidEventId, NoEventHistory, NotFound, OutOfRange
from chainloom.operators.continuity import chain_faults

BLOCK = ["tag", "height", "hash", "parent_hash", "parent_height", "skipped", "block_ts"]


def tag_value(tag: int, stable: int, latest: int) -> int:
    """The tag a request means; above the latest: error."""
    t = stable if tag == 0 else 0 if tag == LITERAL_ZERO else tag
    if t > latest:
        raise InvalidArgument(f"tag {t} is above the latest, {latest}")
    return t


def canonical_blocks(writes: DataFrame, as_of: int | None = None) -> DataFrame:
    """The latest write of every height: a hash aggregation with partial results before its shuffle, no sort."""
    seen = writes if as_of is None else writes.where(F.col("write_seq") <= as_of)
    others = [c for c in writes.columns if c not in ("tag", "height")]
    top = seen.groupBy("tag", "height").agg(F.max_by(F.struct(*others), "write_seq").alias("top"))
    return top.select("tag", "height", "top.*")


def latest_block(watermarks: DataFrame, tag: int) -> DataFrame:
    """The tip: the pointer written last, which isn't the greatest height after a reorg."""
    found = watermarks.where(F.col("tag") == tag).groupBy("tag").agg(F.max_by("height", "write_seq").alias("height"))
    return found.select("tag", "height")


def tip_height(watermarks: DataFrame, tag: int) -> int:
    row = latest_block(watermarks, tag).first()
    if row is None:
        raise NotFound("no block yet")
    return row["height"]


def block_by_height(writes: DataFrame, tag: int, height: int, start_height: int = 0) -> DataFrame:
    if height < start_height:
        raise InvalidArgument(f"height {height} is below the start, {start_height}")
    return canonical_blocks(writes.where((F.col("tag") == tag) & (F.col("height") == height))).select(*BLOCK)


def block_by_hash(writes: DataFrame, tag: int, height: int, hash_: str = "", start_height: int = 0) -> DataFrame:
    """A stored block by its hash, canonical or not; no hash asks for the canonical one."""
    if not hash_:
        return block_by_height(writes, tag, height, start_height)
    mine = writes.where((F.col("tag") == tag) & (F.col("height") == height) & (F.col("hash") == hash_))
    return canonical_blocks(mine).select(*BLOCK)


def check_range(start: int, end: int, most: int | None = None) -> tuple[int, int]:
    """Half-open; end 0 stands for one height."""
    end = end or start + 1
    if start >= end:
        raise OutOfRange(f"[{start}, {end}) is empty")
    if most is not None and end - start > most:
        raise InvalidArgument(f"{end - start} heights; {most} at most")
    return start, end


def blocks_by_range(writes: DataFrame, tag: int, start: int, end: int) -> DataFrame:
    """Canonical blocks of a range, without checks (see ``checked_range``)."""
    mine = writes.where((F.col("tag") == tag) & (F.col("height") >= start) & (F.col("height") < end))
    return canonical_blocks(mine).select(*BLOCK)


def missing_heights(found: DataFrame, start: int, end: int) -> DataFrame:
    wanted = found.sparkSession.range(start, end).toDF("height")
    return wanted.join(found.select("height"), "height", "left_anti")


def checked_range(writes: DataFrame, watermarks: DataFrame, chain: Chain, tag: int, start: int, end: int) -> DataFrame:
    """A range as the service answers it: within limits and the tip, complete, and continuous."""
    tag = tag_value(tag, chain.stable_tag, chain.latest_tag)
    start, end = check_range(start, end, chain.max_block_files)
    if start < chain.block_start_height:
        raise InvalidArgument(f"height {start} is below the start, {chain.block_start_height}")
    if end - 1 > tip_height(watermarks, tag):
        raise FailedPrecondition(f"height {end - 1} is beyond the tip")
    found = blocks_by_range(writes, tag, start, end)
    checked = chain_faults(found).agg(F.count("*").alias("n"), F.count_if("fault").alias("faults")).first()  # both checks in one pass
    if checked["n"] != end - start:
        raise NotFound("some heights have no block")
    if checked["faults"]:
        raise FailedPrecondition("the blocks don't follow one another")
    return found


def blocks_by_heights(writes: DataFrame, tag: int, heights: list[int]) -> DataFrame:
    """Blocks in the order asked for, repeats included; any missing: error."""
    asked = writes.sparkSession.createDataFrame(list(enumerate(heights)), "pos int, height bigint")
    mine = by_keys(writes.where(F.col("tag") == tag), asked.select("height").distinct(), ["height"], complete=True)
    return asked.join(canonical_blocks(mine).drop("tag"), "height").select("pos", F.lit(tag).alias("tag"), *BLOCK[1:])


def files_projection(blocks: DataFrame, chain: Chain) -> DataFrame:
    """What a file answer shows: skipped blocks keep tag, height and the flag only."""
    from chainloom.functions.scalars import compression_of, object_key

    key = object_key(chain, "tag", "height", "hash", F.lit("GZIP"))
    shown = lambda c: F.when(~F.col("skipped"), c)
    return blocks.select("tag", "height", "skipped", shown(F.col("hash")).alias("hash"), shown(F.col("parent_hash")).alias("parent_hash"), shown(key).alias("file_url"), shown(compression_of(key)).alias("compression"))


# --------------------------------------------------------------------- events


def max_event_id(event_watermarks: DataFrame, event_tag: int) -> int:
    row = event_watermarks.where(F.col("event_tag") == event_tag).agg(F.max_by("max_event_id", "write_seq").alias("m")).first()
    if not row["m"]:
        raise NoEventHistory(f"stream {event_tag} has no events")
    return row["m"]


def last_event(events: DataFrame) -> DataFrame:
    """Max event id of each stream, from the log itself."""
    return events.groupBy("event_tag").agg(F.max("event_id").alias("max_event_id"))


def event_by_id(events: DataFrame, event_id: int, most: int) -> DataFrame:
    if event_id > most:
        raise InvalidEventId(f"event {event_id} is beyond {most}")
    return events.where(F.col("event_id") == event_id)


def events_by_range(events: DataFrame, least: int, most: int) -> DataFrame:
    """[least, most); any missing: error."""
    if least < 1:
        raise InvalidArgument("event ids begin at 1")
    found = events.where((F.col("event_id") >= least) & (F.col("event_id") < most))
    if found.count() != most - least:
        raise NotFound("some events are missing")
    return found


def events_after(events: DataFrame, cursor: int, n: int, most: int) -> DataFrame:
    """The page after a cursor: a range of ids, not a limit."""
    if cursor > most:
        raise InvalidEventId(f"cursor {cursor} is beyond {most}")
    return events.where((F.col("event_id") > cursor) & (F.col("event_id") <= min(cursor + max(n, 1), most)))


def first_event_of_height(events: DataFrame, height: int) -> DataFrame:
    return events.where(F.col("height") == height).groupBy("event_tag", "height").agg(F.min("event_id").alias("event_id"))


def events_of_height(events: DataFrame, height: int) -> DataFrame:
    return events.where(F.col("height") == height)


def resolve_cursor(events: DataFrame, sequence: str = "", initial_position: str = "", sequence_num: int = 0, most: int | None = None) -> int:
    """Where a consumer begins: ``sequence``, else ``initial_position``, else ``sequence_num``."""
    if sequence:
        return int(sequence)
    if not initial_position:
        return sequence_num
    if initial_position == "EARLIEST":
        return 0
    if initial_position == "LATEST":
        top = most if most is not None else events.agg(F.max("event_id")).first()[0]
        if not top:
            raise NoEventHistory("no events")
        return top - 1
    row = first_event_of_height(events, int(initial_position)).first()
    if row is None:
        raise NotFound(f"no event for height {initial_position}")
    return row["event_id"] - 1


_SAME = ["height", "hash", "parent_hash", "event_type", "skipped", "tag"]


def versioned_events(source: DataFrame, target: DataFrame) -> DataFrame:
    """Each source event's counterpart in another stream: equal in six columns, the last if there are several."""
    last = target.groupBy(*_SAME).agg(F.max("event_id").alias("target_event_id"))
    s, t = source.alias("s"), last.alias("t")
    on = [F.col(f"s.{c}") == F.col(f"t.{c}") if c in ("height", "event_type") else F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")) for c in _SAME]
    return s.join(t, on).select("s.event_id", "target_event_id")


def versioned_event(source: DataFrame, target: DataFrame, event_id: int) -> DataFrame:
    return versioned_events(source.where(F.col("event_id") == event_id), target)


# --------------------------------------------------------------- transactions


def transaction(index: DataFrame, tag: int, tx_hash: str) -> DataFrame:
    return index.where((F.col("tag") == tag) & (F.col("tx_hash") == tx_hash)).select("tx_hash", "block_number", "block_hash")


def blocks_of_transactions(index: DataFrame, writes: DataFrame) -> DataFrame:
    """Transactions with the canonical block they are in; index rows of reorganised blocks drop out.

    Blocks are first reduced to the heights asked for, so one transaction's lookup reads
    one height.
    """
    blocks = canonical_blocks(writes).select("tag", F.col("height").alias("block_number"), F.col("hash").alias("block_hash"), "parent_hash", "block_ts")
    return index.join(blocks, ["tag", "block_number", "block_hash"])


def require_some(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise NotFound(what)
    return df


def by_keys(df: DataFrame, keys: DataFrame, on: list[str], bound: int = 100_000, how: str = "left_semi", complete: bool = False) -> DataFrame:
    """Rows of a list of keys (or, ``left_anti``, all others), which is broadcast up to ``bound`` keys and shuffled beyond it.

    ``complete``: a key without rows is an error.
    """
    small = keys.limit(bound + 1).count() <= bound
    if complete and not keys.join(df.select(*on), on, "left_anti").isEmpty():
        raise NotFound("some keys have no rows")
    return df.join(F.broadcast(keys) if small else keys, on, how)


def chain_metadata(spark, chain: Chain) -> DataFrame:
    row = (chain.latest_tag, chain.stable_tag, chain.latest_event_tag, chain.stable_event_tag, chain.block_start_height, chain.irreversible_distance, f"{chain.block_time_s}s")
    return spark.createDataFrame([row], "latest_tag int, stable_tag int, latest_event_tag int, stable_event_tag int, block_start_height bigint, irreversible_distance bigint, block_time string")


def rate_limits(calls: DataFrame, client_rps: int, global_rps: int, costs: dict[str, int]) -> DataFrame:
    """Calls per second over their limits: every call is charged to its client and to all.

    ``calls``: (client, method, ts).  One row per client and second with its cost and
    whether it, or that second in all, is over its limit.
    """
    cost: Column = F.lit(1)
    for method, units in costs.items():
        cost = F.when(F.col("method") == method, units).otherwise(cost)
    spent = calls.select("client", F.date_trunc("second", "ts").alias("second"), cost.cast("bigint").alias("cost")).groupBy("client", "second").agg(F.sum("cost").alias("cost"))
    every = spent.groupBy("second").agg(F.sum("cost").alias("total"))
    return spent.join(every, "second").select("client", "second", "cost", "total", (F.col("cost") > client_rps).alias("client_over"), (F.col("total") > global_rps).alias("global_over"))
