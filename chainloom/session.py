"""A client's view of a store: one method per question, each a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.config import Chain
from chainloom.errors import NotFound, NotImplementedForChain
from chainloom.operators import reads
from chainloom.sources.store import Store

_PARSERS: dict[tuple[str, str], object] = {}


def register_parser(family: str, kind: str, parser) -> None:
    """``parser``: DataFrame with ``payload`` (string) -> DataFrame; kinds are native and rosetta."""
    _PARSERS[family, kind] = parser


@dataclass
class Session:
    """Reads of one chain."""

    store: Store
    chain: Chain
    tag: int = 0

    def _tag(self, tag: int | None = None) -> int:
        return reads.tag_value(self.tag if tag is None else tag, self.chain.stable_tag, self.chain.latest_tag)

    def _event_tag(self, event_tag: int) -> int:
        stable = self.chain.stable_event_tag if self.chain.default_stable_event else 0
        return reads.tag_value(event_tag, stable, self.chain.latest_event_tag)

    def get_latest_block(self, tag: int | None = None) -> int:
        height, _ = self.store.snapshot(self._tag(tag))
        if height < 0:
            raise NotFound("no block yet")
        return height

    def get_block_metadata(self, height: int, hash_: str = "", tag: int | None = None) -> DataFrame:
        return reads.block_by_hash(self.store.writes(self._tag(tag)), self._tag(tag), height, hash_, self.chain.block_start_height)

    def get_block(self, height: int, hash_: str = "", tag: int | None = None) -> DataFrame:
        return self.store.payloads(self.get_block_metadata(height, hash_, tag))

    def get_block_files_by_range(self, start: int, end: int = 0, tag: int | None = None) -> DataFrame:
        found = reads.checked_range(self.store.writes(self._tag(tag)), self.store.read("block_watermark"), self.chain, self._tag(tag), start, end)
        return reads.files_projection(found, self.chain)

    def get_blocks_by_range(self, start: int, end: int = 0, tag: int | None = None) -> DataFrame:
        reads.check_range(start, end, self.chain.max_blocks)
        found = reads.checked_range(self.store.writes(self._tag(tag)), self.store.read("block_watermark"), self.chain, self._tag(tag), start, end)
        return self.store.payloads(found).orderBy("height")

    def _parsed(self, blocks: DataFrame, kind: str) -> DataFrame:
        parser = _PARSERS.get((self.chain.family, kind))
        if parser is None:
            raise NotImplementedForChain(f"{self.chain.blockchain} has no {kind} parser")
        return parser(blocks.withColumn("payload", F.col("payload").cast("string")))

    def get_native_blocks_by_range(self, start: int, end: int = 0, tag: int | None = None) -> DataFrame:
        return self._parsed(self.get_blocks_by_range(start, end, tag), "native")

    def get_rosetta_blocks_by_range(self, start: int, end: int = 0, tag: int | None = None) -> DataFrame:
        return self._parsed(self.get_blocks_by_range(start, end, tag), "rosetta")

    def get_block_by_transaction(self, tx_hash: str, tag: int | None = None) -> DataFrame:
        """Blocks that hold a transaction now: none if all that held it were reorganised away."""
        t = self._tag(tag)
        index = reads.require_some(self.store.transactions(t).where(F.col("tx_hash") == tx_hash), f"no transaction {tx_hash}")
        heights = index.select(F.col("block_number").alias("height")).distinct()
        writes = reads.by_keys(self.store.writes(t), heights, ["height"])
        return reads.blocks_of_transactions(index, writes)

    def get_native_transaction(self, tx_hash: str, tag: int | None = None) -> DataFrame:
        """A transaction as the native block that holds it now has it."""
        blocks = self.store.payloads(self.get_block_by_transaction(tx_hash, tag).select("tag", F.col("block_number").alias("height"), F.col("block_hash").alias("hash")).distinct())
        found = self._parsed(blocks, "native")
        key = "tx_hash" if self.chain.family == "evm" else "tx_id"
        return found.select(F.explode("transactions").alias("t")).select("t.*").where(F.col(key) == tx_hash)

    def get_chain_events(self, event_tag: int = 0, sequence: str = "", initial_position: str = "", sequence_num: int = 0, max_events: int = 0) -> DataFrame:
        tag = self._event_tag(event_tag)
        events, most = self.store.events(tag), self.store.max_event_id(tag)
        cursor = reads.resolve_cursor(events, sequence, initial_position, sequence_num, most)
        return reads.events_after(events, cursor, max_events, most).orderBy("event_id")

    def get_versioned_chain_event(self, from_tag: int, event_id: int, to_tag: int) -> DataFrame:
        found = reads.versioned_event(self.store.events(self._event_tag(from_tag)), self.store.events(self._event_tag(to_tag)), event_id)
        if not found.take(1):
            raise NotFound(f"event {event_id} has no counterpart")
        return found

    def get_chain_metadata(self) -> DataFrame:
        return reads.chain_metadata(self.store.spark, self.chain)


def _register_parsers() -> None:
    from chainloom.operators import ledger_blocks, native, parse_other

    parts = "struct<header string, receipts array<string>, traces array<string>, uncles array<string>, author string>"

    def evm(df: DataFrame, chain: str = "ethereum") -> DataFrame:
        p = df.select("payload", F.explode(F.array(F.from_json("payload", parts))).alias("p"))
        some = lambda c: F.coalesce(f"p.{c}", F.array().cast("array<string>")).alias(c)
        # a payload without parts is a header by itself
        return native.evm_blocks(p.select(F.coalesce("p.header", "payload").alias("header"), some("receipts"), some("traces"), some("uncles"), F.col("p.author").alias("author")), chain)

    def solana(df: DataFrame) -> DataFrame:
        return ledger_blocks.solana_blocks(df.select(F.col("height").alias("slot"), "tag", F.col("payload").isNull().alias("skipped"), "payload"))

    def aptos(df: DataFrame) -> DataFrame:
        each = df.select(F.explode(F.from_json(F.get_json_object("payload", "$.transactions"), "array<string>")).alias("transaction"))
        return parse_other.aptos_transactions(each)

    def beacon(df: DataFrame) -> DataFrame:
        part = lambda c: F.get_json_object("payload", f"$.{c}").alias(c)
        return parse_other.beacon_blocks(df.select(F.col("height").alias("slot"), F.col("hash").alias("root"), part("header"), part("block")))

    register_parser("evm", "native", evm)
    register_parser("evm", "rosetta", lambda df: ledger_blocks.evm_ledger_blocks(evm(df)))
    register_parser("solana", "native", solana)
    register_parser("solana", "rosetta", lambda df: ledger_blocks.solana_ledger(solana(df)))
    register_parser("aptos", "native", aptos)
    register_parser("beacon", "native", beacon)
    register_parser("bitcoin", "native", lambda df: parse_other.bitcoin_blocks(df.drop("hash", "height", "block_ts")))
    register_parser("rosetta", "native", lambda df: parse_other.rosetta_ops(df))
    register_parser("rosetta", "rosetta", lambda df: parse_other.rosetta_ops(df))


_register_parsers()
