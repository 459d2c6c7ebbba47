"""Operators against plain walks, and the errors that requests raise."""

import random

import pytest

from chainloom import errors
from chainloom.config import TEST_CHAIN
from chainloom.operators import continuity, fold, parse_evm, parse_other, reads
from chainloom.sources import derived

SCHEMA = "event_tag int, event_id bigint, event_type string, tag int, height bigint, hash string, parent_hash string, skipped boolean"
SF = "/root/testdata/sf0.001"


def script(seed, n=60):
    """A random log of reorgs, and the chain that a stack leaves."""
    rng, rows, stack, version = random.Random(seed), [], [], 0
    for i in range(1, n + 1):
        if stack and rng.random() < 0.35:
            h, x = stack.pop()
            rows.append((0, i, "BLOCK_REMOVED", 1, h, x, stack[-1][1] if stack else "", False))
        else:
            version += 1
            h = stack[-1][0] + 1 if stack else 1
            x = f"{h}v{version}"
            rows.append((0, i, "BLOCK_ADDED", 1, h, x, stack[-1][1] if stack else "", False))
            stack.append((h, x))
    return rows, stack


@pytest.mark.parametrize("seed", range(4))
def test_chain_of_events_is_the_stack(spark, seed):
    rows, stack = script(seed)
    events = spark.createDataFrame(rows, SCHEMA)
    got = continuity.canonical_from_events(events).orderBy("height").collect()
    assert [(r.height, r.hash) for r in got] == stack
    assert continuity.validate_event_pairs(events, bucket=7).count() == 0 and continuity.validate_event_ids(events, bucket=7).count() == 0
    dicts = [dict(zip([c.split()[0] for c in SCHEMA.split(", ")], r)) for r in rows]
    assert fold.check_forwards(dicts) == "" and [(e["height"], e["hash"]) for e in reversed(fold.reduce_backwards(dicts))] == stack


def test_broken_logs(spark):
    rows, _ = script(1)
    bad = [r for r in rows if r[1] != 20]
    events = spark.createDataFrame(bad, SCHEMA)
    assert [r.event_id for r in continuity.validate_event_ids(events, bucket=7).collect()] == [21]
    assert continuity.validate_event_pairs(events, bucket=7).count() >= 1
    assert {r.error == "" for r in fold.stack_errors(events).collect()} == {False}
    dicts = [dict(zip([c.split()[0] for c in SCHEMA.split(", ")], r)) for r in bad]
    with pytest.raises(errors.Discontinuous):
        fold.reduce_backwards(dicts)


@pytest.mark.parametrize("seed", range(3))
def test_chain_check_is_the_walk(spark, seed):
    rng, rows = random.Random(seed), []
    for h in range(80):
        skipped = rng.random() < 0.2
        rows.append((1, h, None, None, None, True) if skipped else (1, h, f"h{h}", None, None, False))
    last, out, bad = ("h-1", -1), [], []
    for tag, h, x, _, _, skipped in rows:
        if skipped:
            out.append((tag, h, None, "", 0, True))
            continue
        p = rng.choice([last[0]] * 8 + ["", "wrong"])
        ph = rng.choice([last[1]] * 8 + [0, 77])
        ph = max(ph, 0)
        out.append((tag, h, x, p, ph, False))
        if p != "" and (p != last[0] or (ph != 0 and ph != last[1])):
            bad.append(h)
        last = (x, h)
    blocks = spark.createDataFrame(out, "tag int, height bigint, hash string, parent_hash string, parent_height bigint, skipped boolean")
    got = sorted(r.height for r in continuity.validate_chain(blocks, (-1, "h-1"), bucket=9).collect())
    assert got == bad


def test_requests(spark):
    writes, marks = derived.block_writes(spark, SF), derived.watermarks(spark, SF)
    tip = reads.tip_height(marks, 1)
    assert tip == 1499 - 37
    for args, error in (((5, 5), errors.OutOfRange), ((9, 5), errors.OutOfRange), ((0, 9999), errors.InvalidArgument), ((tip, tip + 2), errors.FailedPrecondition)):
        with pytest.raises(error):
            reads.checked_range(writes, marks, TEST_CHAIN, 1, *args)
    with pytest.raises(errors.InvalidArgument):
        reads.tag_value(9, 1, 1)
    assert reads.tag_value(0, 3, 4) == 3 and reads.tag_value(4294967295, 3, 4) == 0
    events = derived.chain_events(spark, SF)
    with pytest.raises(errors.InvalidEventId):
        reads.events_after(events, 10, 1, 9)
    assert reads.events_after(events, 9, 5, 9).count() == 0
    with pytest.raises(errors.NotFound):
        reads.events_by_range(events, 1, 10**7)
    with pytest.raises(errors.NotFound):
        reads.resolve_cursor(events, initial_position="999999999")
    assert errors.status_of(errors.NoEventHistory()) == "NOT_FOUND" and errors.status_of(ValueError()) == "INTERNAL"


def test_payload_errors(spark):
    raw = spark.createDataFrame([("{broken",), ('{"number":"0x1"}',), (None,)], "header string")
    assert [r.parse_error for r in parse_evm.parse_headers(raw).collect()] == ["header lacks number,hash,timestamp", "header lacks hash,timestamp", "header lacks number,hash,timestamp"]
    calls = spark.createDataFrame([("t", "nope"), ("u", '{"type":"CALL","from":"0xA","value":"0x' + "f" * 64 + '"}')], "tx_hash string, trace string")
    got = parse_evm.flat_traces(calls).collect()
    assert [(r.tx_hash, r.trace_id, r.value) for r in got] == [("u", "call_u", str(2**256 - 1))]
    errs = spark.createDataFrame([("null",), ('"AccountInUse"',), ('{"InstructionError":[0,{"Custom":1}]}',), (None,)], "err string")
    assert [r[0] for r in errs.select(parse_other.solana_error("err")).collect()] == [None, "AccountInUse", "InstructionError", None]


def test_removals_at_the_edges_of_runs(spark):
    add = lambda i, h: (0, i, "BLOCK_ADDED", 1, h, f"h{h}", f"h{h - 1}", False)
    gone = lambda i, h, tag=1, skipped=False: (0, i, "BLOCK_REMOVED", tag, h, f"h{h}", f"h{h - 1}", skipped)
    begin = [add(i, i) for i in range(1, 10)]
    errors_of = lambda rows: [r.error for r in fold.stack_errors(spark.createDataFrame(begin + rows, SCHEMA), 10).orderBy("part").collect()]
    assert errors_of([gone(10, 9), gone(11, 8), add(12, 8)]) == ["", ""]
    assert errors_of([gone(10, 9, tag=2), gone(11, 8)]) == ["", "event 10 removes another block"]
    assert errors_of([gone(10, 9), gone(11, 8, skipped=True)]) == ["", "event 11 removes another block"]
    assert errors_of([gone(10, 9), gone(11, 9)]) == ["", "event 11 removes another block"]


def test_more_known_duplicates_than_a_broadcast_held(spark):
    txs = spark.range(12_000).selectExpr("id AS number", "0 AS position")
    assert parse_evm.without_known_duplicates(txs, txs.where("number < 11000")).count() == 1000


def test_polygon_ledger_reads_logs_once_and_hashes_each_block_once(spark, monkeypatch):
    import pyarrow as pa
    from pyspark.sql import functions as F

    from chainloom.functions import crypto
    from chainloom.operators import ledger_blocks as lb

    seen, real = [], crypto.keccak_many
    monkeypatch.setattr(crypto, "keccak_many", lambda m: seen.extend(m) or real(m))
    values = [b"a", None, b"b", b"a", b"", b"b"] * 2000
    got = crypto.keccak256.func(pa.array(values, pa.binary())).to_pylist()
    assert got == [None if v is None else crypto.keccak(v) for v in values[:6]] * 2000
    assert len(seen) <= 3 + 5

    word = lambda n: f"{n:064x}"
    swap = lambda n: (lb.HOP_SWAP, [lb.HOP_SWAPPED, "0xid"], "0x" + word(1) + word(n) + word(3))
    done = lambda a: (lb.HOP_BRIDGE.upper().replace("0X", "0x"), [lb.HOP_COMPLETED, "0x" + word(a)], "0x")
    rows = [(0, [swap(5), done(7), swap(6), done(8)]), (1, [swap(5)]), (2, [done(7)]), (3, []), (4, None), (5, [swap(1 << 250), done(7)]), (6, [done(9), swap(4)])]
    logs = spark.createDataFrame(rows, "k int, logs array<struct<address string, topics array<string>, data string>>")
    paid = logs.select("k", lb.polygon_bridge().alias("o"))
    assert [[(x.account, int(x.amount)) for x in r.o] for r in paid.orderBy("k").collect()] == [[(f"0x{8:040x}", 6)], [], [], [], [], [], [(f"0x{9:040x}", 4)]]
    plan = paid._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(lb.HOP_SWAP) == 1 and plan.count(lb.HOP_BRIDGE) == 1

    ops = lb.numbered(logs, F.filter(lb.polygon_bridge(), lambda o: o["amount"] > 4), F.col("k"))
    assert [(r.k, r.op_index, r.o.amount) for r in ops.collect()] == [(0, 0, 6)]
    assert ops._jdf.queryExecution().optimizedPlan().toString().count(lb.HOP_SWAP) == 1


def test_flat_traces_leave_python_as_rows(spark):
    deep = '{"type": "CALL", "value": "0x5", "from": "0xAB", "calls": [{"type": "CREATE", "error": "e", "calls": [{"type": "CALL", "to": ""}]}, {"type": "CALL"}]}'
    broken = '{"type": "CALL", "calls": [{"type": "CALL", "value": "0xzz"}]}'
    rows = [("a", deep), ("b", None), ("c", "no json"), ("d", broken), (None, f" {deep}\n"), ("e", deep + "x"), ("f", "[1]"), ("g", "")]
    raw = spark.createDataFrame(rows, "tx_hash string, trace string")
    made = parse_evm.flat_traces(raw)
    tree = [(0, [], "0", "CALL", "0xab", "5", 2, None, 1), (1, [0], "0", "CREATE", None, "0", 1, "e", 0), (2, [0, 0], "0", "CALL", None, "0", 0, "e", 0), (3, [1], "0", "CALL", None, "0", 0, None, 1)]
    found = [(r.tx_hash, r.position, r.trace_address, "0", r.type, r.from_address, r.value, r.subtraces, r.error, r.status) for r in made.collect()]
    assert sorted(found, key=str) == sorted([(k, *t) for k in ("a", None) for t in tree], key=str)
    assert "posexplode" not in made._jdf.queryExecution().optimizedPlan().toString()
