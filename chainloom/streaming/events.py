"""Event streams: from an append-only log to tables that follow the canonical chain.

The log is a folder of Parquet; Spark's checkpoint holds the cursor, so a restarted query
goes on where it stopped, and sinks that are keyed by event id or (height, sequence) make
repeated batches harmless.  Late data are reorgs: a removal retracts, nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.operators.continuity import canonical_from_events
from chainloom.sources.store import SCHEMAS


def read_events(spark: SparkSession, path: str, max_files: int = 50) -> DataFrame:
    """A stream of the events in a folder."""
    return spark.readStream.schema(SCHEMAS["chain_events"]).option("maxFilesPerTrigger", max_files).parquet(path)


def enrich(events: DataFrame, raw_blocks: DataFrame) -> DataFrame:
    """Events with the payloads of their blocks: a join of the stream with a table."""
    return events.join(raw_blocks.select("tag", "height", "hash", "codec", "payload"), ["tag", "height", "hash"], "left")


def confirmed(blocks: DataFrame, latest: int, irreversible: int, checkpoint: int, batch: int) -> DataFrame:
    """Blocks after a checkpoint that can't be reorganised away any more."""
    end = min(latest - irreversible, checkpoint + batch)
    return blocks.where((F.col("height") > checkpoint) & (F.col("height") <= end))


def versioned_upsert(spark: SparkSession, target: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: each batch writes its events as versions into a folder of its own.

    A batch that runs again overwrites its folder.  Readers take the latest version of
    each height (``current_chain``), so the order of batches doesn't matter.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return write


def current_chain(spark: SparkSession, target: str, as_of: int | None = None) -> DataFrame:
    """The canonical chain that a versioned sink holds, now or at an event id."""
    return canonical_from_events(spark.read.schema(SCHEMAS["chain_events"]).parquet(target), as_of)


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Handle all there is and stop: the batch mode of the same query."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


FOLDED = "event_tag int, height bigint, hash string, event_id bigint, added bigint, removed bigint"


def fold_recent(events: DataFrame, keep: int) -> DataFrame:
    """The last ``keep`` blocks of each stream's chain and counters of events, kept as state.

    Emits the top block after each batch of a stream.  State is bounded by ``keep``; for
    whole chains use the versioned sink, which scales with heights instead of streams.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        heights, hashes, added, removed = state.get if state.exists else ([], [], 0, 0)
        chain = list(zip(heights, hashes))
        last = 0
        for e in pd.concat(list(frames)).sort_values("event_id").itertuples():
            last = e.event_id
            if e.event_type == "BLOCK_ADDED":
                chain.append((e.height, e.hash or ""))
                added += 1
            else:
                if chain and chain[-1][0] == e.height:
                    chain.pop()
                removed += 1
        chain = chain[-keep:]
        state.update(([h for h, _ in chain], [x for _, x in chain], added, removed))
        top = chain[-1] if chain else (None, None)
        yield pd.DataFrame({"event_tag": [key[0]], "height": [top[0]], "hash": [top[1]], "event_id": [last], "added": [added], "removed": [removed]})

    return events.groupBy("event_tag").applyInPandasWithState(step, FOLDED, "heights array<bigint>, hashes array<string>, added bigint, removed bigint", "append", "NoTimeout")
