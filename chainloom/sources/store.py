"""Chain tables as folders of Parquet, appended to, with a pointer written last.

A writer validates, appends data, and appends the watermark row last; a reader resolves the
watermark once and ignores rows written after it.  So a job that dies half way leaves rows
that nobody sees, and its rerun appends them anew under a later ``write_seq``: of rows of
one key the last written before the pointer counts.  Nothing is ever overwritten; taking
events back moves the pointer only.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from chainloom.errors import InvalidArgument, InvalidEventId, NoEventHistory, NotFound
from chainloom.functions.crypto import gunzip, gzip_bytes
from chainloom.operators.continuity import assert_chain, validate_event_ids, validate_event_pairs
from chainloom.operators.reads import canonical_blocks
from chainloom.operators.reorg import number_events

SCHEMAS = {
    "block_meta": "tag int, height bigint, hash string, parent_hash string, parent_height bigint, skipped boolean, block_ts timestamp, object_key string, write_seq bigint",
    "block_watermark": "tag int, height bigint, hash string, write_seq bigint",
    "raw_blocks": "tag int, height bigint, hash string, codec string, payload binary, md5 string, write_seq bigint",
    "chain_events": "event_tag int, event_id bigint, event_type string, tag int, height bigint, hash string, parent_hash string, skipped boolean, write_seq bigint",
    "event_watermark": "event_tag int, max_event_id bigint, write_seq bigint",
    "tx_index": "tag int, tx_hash string, block_number bigint, block_hash string",
    "dlq": "message_id string, topic string, retries int, sent_ts timestamp, data string, deleted boolean, write_seq bigint",
}
#: Leading partition of each table's folders, and the column its files are sorted by.
LAYOUT = {"block_meta": ("tag", "height"), "raw_blocks": ("tag", "height"), "chain_events": ("event_tag", "event_id"), "tx_index": ("tag", "tx_hash")}


def new_path(spark: SparkSession, what: str) -> str:
    """A new folder below the cluster's shared one (``spark.checkpoint.dir``); a temporary one for a local master without it."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise InvalidArgument("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='chain-')}"
    return f"{shared.rstrip('/')}/{what}-{uuid.uuid4().hex}"


@dataclass
class Store:
    """Tables below ``path``."""

    spark: SparkSession
    path: str

    def read(self, name: str) -> DataFrame:
        """A table; empty if nothing was written."""
        try:
            return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], SCHEMAS[name])
            raise

    def append(self, name: str, rows: DataFrame) -> None:
        columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        rows = rows.select(*columns)
        if name in LAYOUT:
            part, order = LAYOUT[name]
            rows.sortWithinPartitions(part, order).write.mode("append").partitionBy(part).parquet(f"{self.path}/{name}")
        elif name.endswith("_watermark"):
            rows.coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")  # a pointer is one row
        else:
            rows.write.mode("append").parquet(f"{self.path}/{name}")  # messages: any number, so not one task

    def next_seq(self, name: str) -> int:
        return (self.read(name).agg(F.max("write_seq")).first()[0] or 0) + 1

    # -------------------------------------------------------------- blocks

    def persist_blocks(self, blocks: DataFrame, update_watermark: bool = True, last_block=None) -> int:
        """Validate and append block metadata, then move the pointer to the highest of them; nothing to do for none."""
        top = blocks.agg(F.max(F.struct("height", "tag", "hash")).alias("top")).first()["top"]
        if top is None:
            return 0
        assert_chain(blocks, last_block)
        seq = max(self.next_seq("block_meta"), self.next_seq("block_watermark"))
        if "object_key" not in blocks.columns:
            blocks = blocks.withColumn("object_key", F.lit(None).cast("string"))
        self.append("block_meta", blocks.withColumn("write_seq", F.lit(seq)))
        if update_watermark:
            self.set_watermark(top["tag"], top["height"], top["hash"], seq)
        return seq

    def set_watermark(self, tag: int, height: int, hash_: str | None, seq: int | None = None) -> None:
        """Point at a block; a lower one than before after a reorg."""
        seq = seq or max(self.next_seq("block_meta"), self.next_seq("block_watermark"))
        self.append("block_watermark", self.spark.createDataFrame([(tag, height, hash_, seq)], SCHEMAS["block_watermark"]))

    def snapshot(self, tag: int) -> tuple[int, int]:
        """(height, write_seq) of the pointer: what a query sees."""
        top = self.read("block_watermark").where(F.col("tag") == tag).agg(F.max_by(F.struct("height", "write_seq"), "write_seq").alias("top")).first()["top"]
        return (-1, 0) if top is None else (top["height"], top["write_seq"])

    def writes(self, tag: int) -> DataFrame:
        """Block metadata written before the pointer: what readers may see, canonical or not."""
        _, seq = self.snapshot(tag)
        return self.read("block_meta").where((F.col("tag") == tag) & (F.col("write_seq") <= seq))

    def canonical(self, tag: int) -> DataFrame:
        """Canonical blocks up to the pointer, as of its writing."""
        height, seq = self.snapshot(tag)
        return canonical_blocks(self.read("block_meta").where((F.col("tag") == tag) & (F.col("height") <= height)), as_of=seq)

    # ------------------------------------------------------------ payloads

    def put_payloads(self, blocks: DataFrame, codec: str = "GZIP") -> None:
        """Append payloads (tag, height, hash, skipped, payload) with their checksum; skipped blocks have none."""
        if codec not in ("NONE", "GZIP"):
            raise InvalidArgument(f"unknown compression {codec}")
        real = blocks.where(~F.col("skipped"))
        data = gzip_bytes("payload") if codec == "GZIP" else F.col("payload")
        stored = real.select("tag", "height", "hash", F.lit(codec).alias("codec"), data.alias("payload"))
        self.append("raw_blocks", stored.withColumn("md5", F.base64(F.unhex(F.md5("payload")))).withColumn("write_seq", F.lit(self.next_seq("raw_blocks"))))

    def payloads(self, blocks: DataFrame) -> DataFrame:
        """Blocks with the payload written last, unpacked; what the metadata says goes before what the payload says.  Skipped blocks have null."""
        raw = self.read("raw_blocks").groupBy("tag", "height", "hash").agg(F.max_by(F.struct("codec", "payload"), "write_seq").alias("p"))
        joined = blocks.join(raw, ["tag", "height", "hash"], "left")
        return joined.withColumn("payload", F.when(F.col("p.codec") == "GZIP", gunzip("p.payload")).otherwise(F.col("p.payload"))).drop("p")

    # -------------------------------------------------------------- events

    def _events_seen(self, event_tag: int) -> tuple[int, int]:
        """(last event id, write_seq) of a stream's pointer."""
        top = self.read("event_watermark").where(F.col("event_tag") == event_tag).agg(F.max_by(F.struct("max_event_id", "write_seq"), "write_seq").alias("top")).first()["top"]
        return (0, 0) if top is None else (top["max_event_id"], top["write_seq"])

    def max_event_id(self, event_tag: int) -> int:
        return self._events_seen(event_tag)[0]

    def events(self, event_tag: int) -> DataFrame:
        """Events up to the stream's pointer; of an id that was written again, after a rewind or a lost job, the last before the pointer."""
        last, seq = self._events_seen(event_tag)
        seen = self.read("chain_events").where((F.col("event_tag") == event_tag) & (F.col("event_id") <= last) & (F.col("write_seq") <= seq))
        columns = [c for c in seen.columns if c not in ("event_tag", "event_id", "write_seq")]
        top = seen.groupBy("event_tag", "event_id").agg(F.max_by(F.struct(*columns), "write_seq").alias("e"))
        return top.select("event_tag", "event_id", "e.*")

    def add_events(self, event_tag: int, events: DataFrame, order: str) -> int:
        """Append events, numbered from the last id + 1 in ``order``; returns the last id."""
        numbered = number_events(events.withColumn("_at", F.col(order)), event_tag, self.max_event_id(event_tag))
        return self.add_event_entries(event_tag, numbered)

    def add_event_entries(self, event_tag: int, entries: DataFrame) -> int:
        """Append events with ids of their own, checked together with up to 20 before them."""
        span = entries.agg(F.min("event_id").alias("a"), F.max("event_id").alias("b")).first()
        top = self.max_event_id(event_tag)
        if span["a"] is None:
            return top
        if span["a"] <= top:
            raise InvalidEventId(f"events from {span['a']} on are there already")
        near = self.events(event_tag).where(F.col("event_id") > span["a"] - 21)
        both = near.unionByName(entries.select(*near.columns))
        if validate_event_ids(both).take(1) or validate_event_pairs(both).take(1):
            raise InvalidArgument("events don't follow one another")
        seq = max(self.next_seq("chain_events"), self.next_seq("event_watermark"))
        self.append("chain_events", entries.withColumn("write_seq", F.lit(seq)))
        self._point(event_tag, span["b"], seq)
        return span["b"]

    def set_max_event_id(self, event_tag: int, event_id: int) -> None:
        """Rewind a stream, by its pointer alone; 0 empties it."""
        top = self.max_event_id(event_tag)
        if not top:
            raise NoEventHistory(f"stream {event_tag} has no events")
        if event_id > top or event_id < 0:
            raise InvalidEventId(f"{event_id} isn't between 0 and {top}")
        self._point(event_tag, event_id)

    def _point(self, event_tag: int, event_id: int, seq: int | None = None) -> None:
        seq = seq or max(self.next_seq("chain_events"), self.next_seq("event_watermark"))
        self.append("event_watermark", self.spark.createDataFrame([(event_tag, event_id, seq)], SCHEMAS["event_watermark"]))

    # -------------------------------------------------------- transactions

    def index_transactions(self, txs: DataFrame) -> None:
        """Append index rows of blocks (tag, block_number, block_hash, tx_hashes); those of a block that comes again show once, as readers see to it."""
        self.append("tx_index", txs.select("tag", F.explode(F.array_distinct("tx_hashes")).alias("tx_hash"), "block_number", "block_hash"))

    def transactions(self, tag: int) -> DataFrame:
        """The transaction index of a tag; rows that a rerun wrote again show once."""
        return self.read("tx_index").where(F.col("tag") == tag).distinct()

    # ----------------------------------------------------------------- dlq

    def send(self, topic: str, message_id: str, data: str, retries: int = 0) -> None:
        row = self.spark.createDataFrame([(message_id, topic, retries, data, False, self.next_seq("dlq"))], "message_id string, topic string, retries int, data string, deleted boolean, write_seq bigint")
        self.append("dlq", row.withColumn("sent_ts", F.current_timestamp()))

    def messages(self) -> DataFrame:
        """The latest state of each message that isn't deleted."""
        columns = [c.split()[0] for c in SCHEMAS["dlq"].split(", ")]
        last = self.read("dlq").groupBy("message_id").agg(F.max_by(F.struct(*columns[1:]), "write_seq").alias("m"))
        return last.select("message_id", "m.*").where(~F.col("deleted"))

    def resend(self, message_id: str) -> None:
        m = self._message(message_id)
        self.send(m["topic"], message_id, m["data"], m["retries"] + 1)

    def delete(self, message_id: str) -> None:
        m = self._message(message_id)
        row = self.spark.createDataFrame([(message_id, m["topic"], m["retries"], m["data"], True, self.next_seq("dlq"))], "message_id string, topic string, retries int, data string, deleted boolean, write_seq bigint")
        self.append("dlq", row.withColumn("sent_ts", F.current_timestamp()))

    def _message(self, message_id: str):
        m = self.messages().where(F.col("message_id") == message_id).first()
        if m is None:
            raise NotFound(f"no message {message_id}")
        return m

    def settle(self, outcomes: DataFrame, most_retries: int | None = None) -> None:
        """Write down what became of messages (message_id, done): those that are done go, the others wait with one retry more.

        With ``most_retries`` a message that has used them up goes too.  One append for all of them.
        """
        now = self.messages().join(outcomes, "message_id").withColumn("retries", F.when(F.col("done"), F.col("retries")).otherwise(F.col("retries") + 1))
        spent = F.lit(False) if most_retries is None else F.col("retries") > most_retries
        self.append("dlq", now.withColumn("deleted", F.col("done") | spent).withColumn("sent_ts", F.current_timestamp()).withColumn("write_seq", F.lit(self.next_seq("dlq"))))
