"""Sinks, the node source, ingestion cycles, sessions and streams."""

import json

import pytest
from pyspark.sql import functions as F

from chainloom import errors
from chainloom.config import Chain
from chainloom.functions import crypto
from chainloom.plans.pipelines import Ingest
from chainloom.session import Session
from chainloom.sources.store import Store
from chainloom.streaming import events as ev

CHAIN = Chain("toy", "local", irreversible_distance=3, latest_event_tag=1, max_blocks=50)


def record(path, heights, salt=""):
    for h in heights:
        block = {"skipped": True} if h % 7 == 5 else {"height": h, "hash": f"h{h}{salt if h >= 12 else ''}", "parent_height": h - 1 - ((h - 1) % 7 == 5) if h else 0, "parent_hash": f"h{h - 1 - ((h - 1) % 7 == 5)}{salt if h - 1 - ((h - 1) % 7 == 5) >= 12 else ''}" if h else ""}
        (path / f"{h}.json").write_text(json.dumps(block))


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("world")
    node = home / "node"
    node.mkdir()
    record(node, range(17))
    store = Store(spark, f"file://{home}/store")
    return Ingest(store, CHAIN, str(node)), Session(store, CHAIN), node, home


def test_cycles(spark, world):
    ingest, session, node, home = world
    with pytest.raises(errors.NotFound):
        session.get_latest_block()
    assert ingest.poll(most=10)["blocks"] == 10 and session.get_latest_block() == 9
    assert ingest.poll(most=10)["blocks"] == 7 and session.get_latest_block() == 16
    assert ingest.stream_events(0, batch=8) == 8 and ingest.stream_events(0) == 17
    with pytest.raises(errors.FailedPrecondition):
        session.get_blocks_by_range(10, 18)
    got = session.get_blocks_by_range(3, 7).collect()
    assert [r.height for r in got] == [3, 4, 5, 6] and json.loads(bytes(got[0].payload))["hash"] == "h3" and got[2].payload is None
    # the node changes its mind from 12 on
    record(node, range(12, 18), "x")
    out = ingest.poll()
    assert (out["fork"], out["distance"], out["result"]) == (11, 5, "error") and session.get_latest_block() == 17
    assert session.get_block_metadata(13).first()["hash"] == "h13x" and session.get_block_metadata(13, "h13").first()["hash"] == "h13"
    assert ingest.stream_events(0) == 17 + 4 + 5
    page = session.get_chain_events(sequence="17", max_events=5).collect()
    assert [(r.event_type, r.height) for r in page] == [("BLOCK_REMOVED", h) for h in (16, 15, 14, 13)] + [("BLOCK_ADDED", 13)]
    assert session.get_chain_events(initial_position="LATEST").first()["height"] == 17
    assert ingest.monitor(0).count() == 0 and ingest.cross_validate(str(node), 0, 18, 50).count() == 0
    assert ingest.backfill_events(0, 1) == 26
    assert session.get_versioned_chain_event(0, 26, 1).first()["target_event_id"] == 26
    with pytest.raises(errors.InvalidEventId):
        ingest.store.set_max_event_id(0, 99)
    ingest.store.set_max_event_id(0, 20)
    assert ingest.store.max_event_id(0) == 20 and ingest.store.events(0).count() == 20
    other = Ingest(Store(spark, f"file://{home}/copy"), CHAIN, str(node))
    assert other.replicate(ingest.store, 0, 18, "NONE") == 17
    copied = other.store.payloads(other.store.canonical(1)).where("height = 3").first()
    assert json.loads(bytes(copied.payload))["hash"] == "h3"
    with pytest.raises(errors.Discontinuous):
        ingest.store.persist_blocks(ingest.fetch(0, 3).withColumn("parent_hash", F.lit("zz")).drop("payload"))


def test_lost_jobs_show_nothing(spark, tmp_path, monkeypatch):
    """Jobs that die between their data and their pointer leave nothing to see, and reruns show once."""
    store = Store(spark, f"file://{tmp_path}/store")
    session = Session(store, CHAIN, tag=0)
    block = lambda h, x="": (1, h, f"h{h}{x}", f"h{h - 1}" if h else "", max(h - 1, 0), False, None)
    frame = lambda *rows: spark.createDataFrame(list(rows), "tag int, height bigint, hash string, parent_hash string, parent_height bigint, skipped boolean, block_ts timestamp")
    event = lambda i, x="": (0, i, "BLOCK_ADDED", 1, i - 1, f"h{i - 1}{x}", f"h{i - 2}" if i > 1 else "", False)
    events = lambda *rows: spark.createDataFrame(list(rows), "event_tag int, event_id bigint, event_type string, tag int, height bigint, hash string, parent_hash string, skipped boolean")
    store.persist_blocks(frame(*map(block, range(3))))
    store.add_event_entries(0, events(event(1), event(2)))

    class Lost(Exception):
        pass

    def lost(*_):
        raise Lost

    with monkeypatch.context() as m:
        m.setattr(Store, "set_watermark", lost)
        m.setattr(Store, "_point", lost)
        with pytest.raises(Lost):
            store.persist_blocks(frame(block(2, "x")))
        with pytest.raises(Lost):
            store.add_event_entries(0, events(event(3), event(4, "lost")))
    assert session.get_latest_block() == 2 and session.get_block_metadata(2).first()["hash"] == "h2"
    assert session.get_block(2).count() == 1 and store.events(0).count() == 2
    assert store.add_event_entries(0, events(event(3))) == 3
    assert [(r.event_id, r.hash) for r in store.events(0).orderBy("event_id").collect()] == [(1, "h0"), (2, "h1"), (3, "h2")]
    assert store.add_event_entries(0, events(event(4))) == 4 and store.events(0).where("event_id = 4").first()["hash"] == "h3"
    store.set_max_event_id(0, 1)
    assert store.events(0).count() == 1
    assert store.add_event_entries(0, events(event(2))) == 2 and store.events(0).count() == 2
    payload = lambda x: spark.createDataFrame([(1, 2, "h2", False, bytearray(x))], "tag int, height bigint, hash string, skipped boolean, payload binary")
    store.put_payloads(payload(b"zzz"), "NONE")
    store.put_payloads(payload(b"aaa"), "NONE")
    assert bytes(session.get_block(2).first()["payload"]) == b"aaa"
    txs = spark.createDataFrame([(1, 2, "h2", ["t"])], "tag int, block_number bigint, block_hash string, tx_hashes array<string>")
    store.index_transactions(txs)
    store.index_transactions(txs)
    assert session.get_block_by_transaction("t").count() == 1


def test_transactions_and_messages(spark, world):
    ingest, session, _, _ = world
    ingest.store.index_transactions(spark.createDataFrame([(1, 3, "h3", ["t1", "t2"]), (1, 13, "h13", ["t3"]), (1, 13, "h13x", ["t3"])], "tag int, block_number bigint, block_hash string, tx_hashes array<string>"))
    assert [r.block_hash for r in session.get_block_by_transaction("t3").collect()] == ["h13x"] 
    with pytest.raises(errors.NotFound):
        session.get_block_by_transaction("none")
    s = ingest.store
    s.send("failed_block", "m1", "{}")
    s.send("failed_block", "m2", "{}")
    s.resend("m1")
    s.delete("m2")
    assert [(r.message_id, r.retries) for r in s.messages().collect()] == [("m1", 1)]
    with pytest.raises(errors.NotFound):
        s.delete("m2")


def test_streams(spark, tmp_path):
    log, rows = f"file://{tmp_path}/log", []
    script = [("+", 1, "a"), ("+", 2, "b"), ("+", 3, "c"), ("-", 3, "c"), ("-", 2, "b"), ("+", 2, "B"), ("+", 3, "C")]
    for i, (sign, h, x) in enumerate(script, 1):
        rows.append((0, i, "BLOCK_ADDED" if sign == "+" else "BLOCK_REMOVED", 1, h, x, "", False))
    schema = "event_tag int, event_id bigint, event_type string, tag int, height bigint, hash string, parent_hash string, skipped boolean"
    spark.createDataFrame(rows[:4], schema).coalesce(1).write.parquet(log)
    sink, mark = f"file://{tmp_path}/sink", f"file://{tmp_path}/mark"
    run = lambda: ev.run_available(ev.read_events(spark, log), ev.versioned_upsert(spark, sink), mark)
    run()
    assert [(r.height, r.hash) for r in ev.current_chain(spark, sink).orderBy("height").collect()] == [(1, "a"), (2, "b")]
    spark.createDataFrame(rows[4:], schema).coalesce(1).write.mode("append").parquet(log)
    run()
    assert [(r.height, r.hash) for r in ev.current_chain(spark, sink).orderBy("height").collect()] == [(1, "a"), (2, "B"), (3, "C")]
    assert ev.current_chain(spark, sink, as_of=3).count() == 3
    q = ev.fold_recent(ev.read_events(spark, log), 2).writeStream.format("memory").queryName("folded").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/fold").trigger(availableNow=True).start()
    q.awaitTermination()
    top = spark.table("folded").orderBy(F.desc("event_id")).first()
    assert (top.height, top.hash, top.added, top.removed) == (3, "C", 5, 2)


def test_crypto(spark):
    assert crypto.keccak(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    df = spark.createDataFrame([("0x5aaeb6053f3e94c9b9a09f33669435e7ef1beaed", "0x" + "f" * 64, b"\0\0hi"), (None, "0x1" + "0" * 64, None)], "a string, n string, b binary")
    out = df.select(crypto.checksum_address("a"), crypto.uint256("n"), crypto.from_base58(crypto.to_base58("b")), crypto.gunzip(crypto.gzip_bytes("b")), crypto.pubkey_address(F.lit("0279BE667EF9DCBBAC55A06295CE870B07029BFCDB2DCE28D959F2815B16F81798"))).collect()
    assert tuple(out[0]) == ("0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed", str(2**256 - 1), b"\0\0hi", b"\0\0hi", "1BgGZ9tcN4rm9KBzDn7KprQz87SZ26SAMH")
    assert tuple(out[1])[:4] == (None, None, None, None)
