"""Ingestion as jobs over a store: each cycle reads a node, validates, writes, and moves the pointer last."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.config import Chain
from chainloom.errors import Discontinuous, InvalidArgument
from chainloom.operators import continuity, reads, reorg, verify
from chainloom.sources import node
from chainloom.sources.store import Store


@dataclass
class Ingest:
    """A chain's node recording and its store."""

    store: Store
    chain: Chain
    path: str
    tag: int = 1

    def fetch(self, start: int, end: int, path: str | None = None) -> DataFrame:
        node.register(self.store.spark)
        rows = self.store.spark.read.format("chain_node").option("path", path or self.path).option("start", start).option("end", end).load()
        return rows.withColumn("tag", F.lit(self.tag)).withColumn("block_ts", F.lit(None).cast("timestamp"))

    def backfill(self, start: int, end: int, batch: int = 2500, update_watermark: bool = False, fallback: str | None = None) -> int:
        """Ingest [start, end) in batches, each validated against the last block before it; returns how many blocks."""
        reads.check_range(start, end)
        done = 0
        for a in range(start, end, batch):
            b = min(a + batch, end)
            blocks = self.fetch(a, b)
            if fallback:
                blocks = reorg.primary_or_secondary(blocks, self.fetch(a, b, fallback), ["height"])
            blocks = blocks.persist()
            try:
                if blocks.count() != b - a:
                    raise Discontinuous(f"the node lacks some of [{a}, {b})")
                before = self.store.read("block_meta").where((F.col("tag") == self.tag) & (F.col("height") < a) & ~F.col("skipped"))
                last = reads.canonical_blocks(before).agg(F.max(F.struct("height", "hash")).alias("l")).first()["l"]
                self._load(blocks, update_watermark, None if last is None else (last["height"], last["hash"]))
                done += b - a
            finally:
                blocks.unpersist()
        return done

    def _load(self, blocks: DataFrame, update_watermark: bool, last) -> None:
        self.store.put_payloads(blocks.withColumn("payload", F.col("payload").cast("binary")))
        self.store.persist_blocks(blocks.drop("payload"), update_watermark, last)

    def poll(self, most: int = 100, window: int = 100) -> dict:
        """One cycle at the tip: find the fork, rewind to it, ingest what is above, without trailing skipped blocks."""
        tip, _ = self.store.snapshot(self.tag)
        latest = node.latest_height(self.path)
        if tip < 0:
            n = self.backfill(self.chain.block_start_height, min(latest, self.chain.block_start_height + most - 1) + 1, update_watermark=True)
            return {"fork": -1, "distance": 0, "blocks": n, "result": "success"}
        fork, size = None, window
        while fork is None:
            low = max(tip - size + 1, self.chain.block_start_height)
            mine = self.store.canonical(self.tag).where(F.col("height") >= low)
            found = reorg.fork_height(mine, self.fetch(low, tip + 1)).first()
            fork = found["fork_height"] if found else None
            if fork is None and low == self.chain.block_start_height:
                raise Discontinuous("the node's chain and the stored one have no block in common")
            size *= 2
        distance = tip - fork
        result = "error" if 0 < self.chain.irreversible_distance <= distance else "success"
        held = reads.canonical_blocks(self.store.read("block_meta").where((F.col("tag") == self.tag) & (F.col("height") == fork))).first()
        blocks = continuity.trim_trailing_skipped(self.fetch(fork + 1, min(latest, fork + most) + 1)).persist()
        try:
            if not continuity.descends_from(blocks, held["hash"]):
                return {"fork": fork, "distance": distance, "blocks": 0, "result": "retry"}
            if distance:
                self.store.set_watermark(self.tag, fork, held["hash"])
            n = blocks.count()
            if n:
                self._load(blocks, True, (held["height"], held["hash"]))
        finally:
            blocks.unpersist()
        return {"fork": fork, "distance": distance, "blocks": n, "result": result}

    def next_heights(self, latest: int, most: int = 100) -> DataFrame:
        """Heights that a fast cycle takes up: those above the tip, with no look for reorgs."""
        tip, _ = self.store.snapshot(self.tag)
        start = max(tip + 1, self.chain.block_start_height)
        return self.store.spark.range(start, min(latest, start + most - 1) + 1).toDF("height")

    def stream_events(self, event_tag: int, batch: int = 500) -> int:
        """One cycle of the event stream: removals down to the fork, then additions; returns the last event id."""
        canonical = self.store.canonical(self.tag)
        changes = reorg.streamer_changes(self.store.events(event_tag), canonical, event_tag, batch, self.chain.block_start_height)
        return self.store.add_event_entries(event_tag, changes)

    def backfill_events(self, old_event_tag: int, new_event_tag: int) -> int:
        """Events of an old stream as a new stream, against the blocks of this tag."""
        made = reorg.reconcile_events(self.store.events(old_event_tag), self.store.canonical(self.tag), new_event_tag)
        return self.store.add_event_entries(new_event_tag, made)

    def replicate(self, source: Store, start: int, end: int, codec: str = "GZIP") -> int:
        """Copy blocks of another store, packed anew, and then move the pointer over what is continuous."""
        blocks = source.canonical(self.tag).where((F.col("height") >= start) & (F.col("height") < end))
        full = source.payloads(blocks).persist()
        try:
            self.store.put_payloads(full, codec)
            self.store.persist_blocks(full.drop("payload", "write_seq"), update_watermark=False)
        finally:
            full.unpersist()
        return self.update_watermark(start, end - 1)

    def update_watermark(self, validate_start: int, height: int) -> int:
        """Point at a height after checking the chain from ``validate_start`` to it."""
        mine = self.store.read("block_meta").where((F.col("tag") == self.tag) & F.col("height").between(max(validate_start, 0), height))
        blocks = continuity.assert_chain(reads.canonical_blocks(mine))
        top = blocks.where(F.col("height") == height).first()
        if top is None:
            raise InvalidArgument(f"height {height} isn't stored")
        self.store.set_watermark(self.tag, height, top["hash"])
        return height

    def monitor(self, start: int, most: int = 1000, padding: int = 0) -> DataFrame:
        """Differences between node and store over a closed range below the tip, counted by reason."""
        tip, _ = self.store.snapshot(self.tag)
        end = min(node.latest_height(self.path) - padding, tip, start + most - 1)
        columns = ["tag", "hash", "parent_hash", "parent_height", "skipped"]
        found = verify.compare_blocks(self.fetch(start, end + 1), self.store.canonical(self.tag).where(F.col("height").between(start, end)), columns)
        return found.groupBy("differences").agg(F.count("*").alias("n"))

    def cross_validate(self, second: str, start: int, end: int, percent: int = 10) -> DataFrame:
        """Differences from a second node over a sample of [start, end)."""
        columns = ["tag", "hash", "parent_hash", "parent_height", "skipped"]
        theirs = verify.sampled_heights(self.fetch(start, end, second), percent)
        mine = verify.sampled_heights(self.store.canonical(self.tag).where((F.col("height") >= start) & (F.col("height") < end)), percent)
        return verify.compare_blocks(theirs, mine, columns)

    def benchmark(self, start: int, end: int, samples: int, step: int) -> DataFrame:
        """Seconds that backfills of ``samples`` heights take, every ``step`` heights."""
        import time

        if end < start + samples + step:
            raise InvalidArgument("the range holds no sample")
        rows = []
        for a in range(start, end - samples + 1, step):
            began = time.time()
            self.backfill(a, a + samples)
            rows.append((a, samples, time.time() - began))
        return self.store.spark.createDataFrame(rows, "start bigint, blocks int, seconds double")
