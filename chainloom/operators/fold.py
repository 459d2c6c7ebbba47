"""Folds over the event log in its order, for where no relational form exists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainloom.errors import Discontinuous


def _follows(upper, lower) -> bool:
    if upper["height"] != lower["height"] + 1:
        return False
    return bool(upper["skipped"] or lower["skipped"] or not upper["parent_hash"] or upper["parent_hash"] == lower["hash"])


def reduce_backwards(rows: list[dict]) -> list[dict]:
    """What is left of events (oldest first) when additions and their removals cancel, newest first.

    Raises where neighbours don't fit.
    """
    left: list[dict] = []
    for e in reversed(rows):
        if left:
            newer = left[-1]
            if e["event_type"] == newer["event_type"]:
                upper, lower = (newer, e) if e["event_type"] == "BLOCK_ADDED" else (e, newer)
                if not _follows(upper, lower):
                    raise Discontinuous(f"events {e['event_id']} and {newer['event_id']} don't follow one another")
            elif e["event_type"] == "BLOCK_ADDED":
                if e["height"] != newer["height"] or e["hash"] != newer["hash"]:
                    raise Discontinuous(f"event {newer['event_id']} removes another block than event {e['event_id']} added")
                left.pop()
                continue
            elif e["height"] != newer["height"]:
                raise Discontinuous(f"event {newer['event_id']} doesn't replace what event {e['event_id']} removed")
        left.append(e)
    return left


def check_forwards(rows: list[dict]) -> str:
    """Push additions, pop removals: the first error, or nothing.

    A removal that meets an empty stack is held against ``before_*``, what the log last said
    of its height, if rows have that.
    """
    stack: list[dict] = []
    for e in rows:
        if e["event_type"] == "BLOCK_ADDED":
            if stack and not _follows(e, stack[-1]):
                return f"event {e['event_id']} doesn't follow its predecessor"
            stack.append(e)
        else:
            if stack:
                top = stack.pop()
                if any(top[c] != e[c] for c in ("height", "hash", "tag", "skipped")):
                    return f"event {e['event_id']} removes another block"
            elif e.get("before_event_type"):
                if e["before_event_type"] != "BLOCK_ADDED" or any(e[f"before_{c}"] != e[c] for c in ("hash", "tag", "skipped")):
                    return f"event {e['event_id']} removes another block"
    return ""


def stack_errors(events: DataFrame, window: int = 10_000) -> DataFrame:
    """(event_tag, part, error) of runs of ``window`` events, each checked in order.

    The log is cut into runs, so the check is as parallel as the log is long; a removal of
    a block added in an earlier run is held against the event before it of the same height.
    """
    of_height = Window.partitionBy("event_tag", "height").orderBy("event_id")
    before = {f"before_{c}": F.lag(c).over(of_height) for c in ("event_type", "hash", "tag", "skipped")}
    cut = events.withColumns({"part": F.floor(F.col("event_id") / F.lit(window)), **before})

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("event_id").astype(object).where(pdf.notna(), None).to_dict("records")
        return pd.DataFrame({"event_tag": [rows[0]["event_tag"]], "part": [rows[0]["part"]], "error": [check_forwards(rows)]})

    return cut.select("event_tag", "part", "event_id", "event_type", "tag", "height", "hash", "parent_hash", "skipped", *before).groupBy("event_tag", "part").applyInPandas(check, "event_tag int, part bigint, error string")
