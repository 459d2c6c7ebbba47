"""Plans that grow no faster than their tables: each table is read once, rows are thin where they are shuffled."""

import glob

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from chainloom.operators import ledger_blocks
from chainloom.plans import blocks
from chainloom.sources import derived
from chainloom.sources.store import Store

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def scans(df, column: str = "l_orderkey") -> int:
    """How often a plan reads the table with a column."""
    return sum(line.count(f"[{column}#") for line in plan(df).splitlines() if "Relation [" in line)


def repeated(df) -> bool:
    """Whether a filter makes a list anew that a projection above it makes too."""
    return any("Filter" in line and "transform(" in line for line in plan(df).splitlines())


@pytest.mark.parametrize("name", ["v6_solana_residuals", "l12_solana_ledger", "x15_solana_blocks"])
def test_solana_blocks_are_read_and_made_once(spark, name):
    df = e.queries()[name](spark, SF)
    assert scans(df) == 1 and not repeated(df)


@pytest.mark.parametrize("name", ["x2_native_blocks", "x5_logs", "l1_evm_ledger"])
def test_evm_blocks_are_read_and_made_once(spark, name):
    df = e.queries()[name](spark, SF)
    assert scans(df) == 1 and not repeated(df)
    assert ("flatten_calls" in plan(df)) == (name != "x5_logs")  # logs need no traces


def test_one_transaction_parses_its_own_block(spark):
    df = e.queries()["q9_native_transaction"](spark, SF)
    assert scans(df) == 1 and plan(df).count("from_json") <= 3
    assert df.count() == 1


def test_residuals_of_rows_and_of_a_ledger_agree(spark):
    native = ledger_blocks.solana_blocks(blocks.solana_raw_blocks(spark, SF))
    both = [sorted(map(str, ledger_blocks.solana_residuals(native, *given).collect())) for given in ([], [ledger_blocks.solana_ledger(native)])]
    assert both[0] == both[1] and both[0]


@pytest.mark.parametrize("name", ["x3_evm_transactions", "x2_evm_headers", "x2_native_blocks", "l12_solana_ledger"])
def test_payloads_are_made_after_the_shuffle(spark, name):
    lines = plan(e.queries()[name](spark, SF)).splitlines()
    gathered = next(i for i, line in enumerate(lines) if "collect_list" in line)
    assert not any("md5(" in line for line in lines[gathered + 1 :])
    assert "0xA" not in lines[gathered].split("collect_list")[1].split(" AS rows")[0]


def test_callers_are_met_in_one_shuffle(spark):
    p = plan(e.queries()["x8_parity_errors"](spark, SF))
    assert "Join" not in p and p.count("Aggregate") == 1


def test_chosen_traces_split_without_a_shuffle(spark):
    assert "Join LeftAnti, (number" not in plan(e.queries()["n5_chosen_traces"](spark, SF))


def test_messages_are_written_by_all_tasks(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    row = spark.range(400).repartition(4).select(F.col("id").cast("string").alias("message_id"), F.lit("t").alias("topic"), F.lit(0).alias("retries"), F.current_timestamp().alias("sent_ts"), F.lit("{}").alias("data"), F.lit(False).alias("deleted"), F.lit(1).cast("bigint").alias("write_seq"))
    store.append("dlq", row)
    assert len(glob.glob(f"{tmp_path}/dlq/*.parquet")) == 4 and store.messages().count() == 400


def test_index_is_packed_by_one_shuffle(spark):
    packed = derived.packed_tx_index(spark, SF)
    assert plan(packed).count("Aggregate") == 1
    each = packed.select("tag", F.explode("tx_hashes").alias("tx_hash"), "block_number", "block_hash")
    index = derived.tx_index(spark, SF).select(*each.columns)
    assert each.exceptAll(index).isEmpty() and index.exceptAll(each).isEmpty()
