"""Recorded chain nodes as a Spark data source.

``spark.read.format("chain_node").option("path", ...)`` reads folders of recorded answers,
one JSON file per height (``<height>.json``; ``{"skipped": true}`` for a height without a
block), in parallel by ranges of heights.  The folder must be one that all executors see.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "height bigint, hash string, parent_hash string, parent_height bigint, skipped boolean, payload string"


class Heights(InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__((start, end))
        self.start, self.end = start, end


def _rows(path: str, start: int, end: int) -> Iterator[tuple]:
    for h in range(start, end):
        name = os.path.join(path, f"{h}.json")
        if not os.path.exists(name):
            continue
        with open(name) as f:
            text = f.read()
        block = json.loads(text)
        if block.get("skipped"):
            yield h, None, None, None, True, None
        elif int(block["height"]) != h:
            raise ValueError(f"asked for height {h}, got {block['height']}")
        else:
            yield h, block["hash"], block.get("parent_hash", ""), block.get("parent_height", max(h - 1, 0)), False, text


def latest_height(path: str) -> int:
    return max((int(n[:-5]) for n in os.listdir(path) if n.endswith(".json")), default=-1)


class NodeReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.start = int(options.get("start", 0))
        self.end = int(options.get("end", latest_height(self.path) + 1))
        self.batch = int(options.get("batch", 1000))

    def partitions(self):
        return [Heights(h, min(h + self.batch, self.end)) for h in range(self.start, self.end, self.batch)] or [Heights(0, 0)]

    def read(self, partition):
        yield from _rows(self.path, partition.start, partition.end)


class NodeStreamReader(SimpleDataSourceStreamReader):
    """New heights as the recording grows; the offset is the next height."""

    def __init__(self, options):
        self.path = options["path"]
        self.first = int(options.get("start", 0))

    def initialOffset(self):
        return {"height": self.first}

    def read(self, start):
        end = latest_height(self.path) + 1
        at = min(start["height"], end) if end else start["height"]
        return _rows(self.path, at, end), {"height": max(end, at)}

    def readBetweenOffsets(self, start, end):
        return _rows(self.path, start["height"], end["height"])


class ChainNode(DataSource):
    @classmethod
    def name(cls):
        return "chain_node"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return NodeReader(self.options)

    def simpleStreamReader(self, schema):
        return NodeStreamReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(ChainNode)
