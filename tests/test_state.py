"""Levelled logs: what a batch reads and writes, folding, replays and failures."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from retailflow.streaming import ledger
from retailflow.streaming.log import Log, Run

SCHEMA = StructType().add("k", LongType()).add("v", LongType())


def counter(spark, tmp_path, **options):
    """A log of increments per key."""

    def summed(rows):
        return rows.groupBy("k").agg(F.sum("v").alias("v"), F.max("batch_id").alias("batch_id"))

    return Log(spark, str(tmp_path / "log"), SCHEMA, "k", summed, **options)


def rows(spark, pairs):
    return spark.createDataFrame(pairs, SCHEMA)


def sums(log, **where):
    return {r["k"]: r["s"] for r in log.read(**where).groupBy("k").agg(F.sum("v").alias("s")).collect()}


def test_lookup_opens_a_bounded_part_however_long_the_log(spark, tmp_path):
    opened = {}
    for size in (4_000, 32_000):
        log = counter(spark, tmp_path / str(size), rows_per_bucket=100)
        log.write(spark.range(size).select(F.col("id").alias("k"), F.lit(1).alias("v")), 0)
        keys = [random.Random(size).randrange(size) for _ in range(30)]
        found = log.read(1, rows(spark, [(k, 0) for k in keys]).select("k"))
        opened[size] = len(found.inputFiles()), len(log.read().inputFiles())
        assert set(keys) <= {r["k"] for r in found.collect()}
    assert opened[4_000][0] <= 30 and opened[32_000][0] <= 30
    # the whole log grew by the factor, what the batch opens did not
    assert opened[4_000][1] >= 32 and opened[32_000][1] >= 256


def test_a_batch_writes_as_many_buckets_as_it_needs(spark, tmp_path):
    log = counter(spark, tmp_path, rows_per_bucket=1000)
    log.write(rows(spark, [(k, 1) for k in range(10)]), 0)
    log.write(spark.range(16_000).select(F.col("id").alias("k"), F.lit(1).alias("v")), 1)
    assert [r.depth for r in log.runs()] == [0, 4]
    assert len(log.batch(0).inputFiles()) == 1 and len(log.batch(1).inputFiles()) == 16


def test_five_hundred_batches_leave_few_runs(spark, tmp_path):
    log = counter(spark, tmp_path, fan=20)
    for n in range(500):
        # written without a job each: the test is about folding
        folder = f"{log.path}/{Run(n, n, 0).name}"
        batch_rows(folder, [(n % 7, 1, n), (n, 2, n)])
        log.fold(n)
    assert len(log.runs()) <= 2 * 19 + 2
    assert sum(r.width for r in log.runs()) == 500
    want = {}
    for n in range(500):
        want[n % 7] = want.get(n % 7, 0) + 1
        want[n] = want.get(n, 0) + 2
    assert sums(log) == want


def batch_rows(folder, triples):
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    os.makedirs(f"{folder}/bucket=0")
    table = pa.table(dict(zip(("k", "v", "batch_id"), map(list, zip(*triples)))))
    pq.write_table(table, f"{folder}/bucket=0/part-0.parquet")
    open(f"{folder}/_SUCCESS", "w").close()


def test_a_replayed_batch_sees_the_state_before_it(spark, tmp_path):
    log = counter(spark, tmp_path, fan=2)
    for n in range(6):
        log.write(rows(spark, [(1, 10**n)]), n)
        log.fold(n)
    assert sums(log, before=5) == {1: 11111}
    # its run is already there, and everything before it is folded
    log.write(rows(spark, [(1, 10**5), (2, 1)]), 5)
    log.fold(5)
    assert sums(log, before=5) == {1: 11111} and sums(log) == {1: 111111, 2: 1}


def test_a_fold_may_stop_anywhere(spark, tmp_path, monkeypatch):
    log = counter(spark, tmp_path, fan=3)
    for n in range(3):
        log.write(rows(spark, [(n, 1), (0, 1)]), n)
    want = sums(log)
    # stopped while the merged run is being written: no success mark yet
    merged = log.save(log._load([log.folder(r) for r in log.runs()]), 0, 2, 6)
    log._files().delete(log._hadoop(f"{log.folder(merged)}/_SUCCESS"), False)
    assert sums(log) == want and len(log.runs()) == 3
    # stopped after it was finished, before the old runs went
    log.fold(3)
    assert sums(log) == want and log.runs() == [Run(0, 2, 0)]
    assert len(log._found()) == 4
    log.fold(4)
    assert sums(log) == want and len(log._found()) == 1


def test_entries_keep_newest_and_cursor_when_folded(spark, tmp_path):
    schema = StructType.fromDDL("id bigint, type string, version bigint")
    log = Log(spark, str(tmp_path / "log"), schema, "id", ledger.newest_entries("id", "type"), fan=2)
    feed = [[(1, "A", 9)], [(1, "B", 3)], [(1, "B", 4), (2, None, 1)], [(2, None, 2)]]
    for n, batch in enumerate(feed):
        log.write(spark.createDataFrame(batch, schema), n)
        log.fold(n)
    log.fold(4)
    assert len(log.runs()) == 1
    newest = {(r["id"], r["version"]) for r in ledger.latest(log.read(), "id").collect()}
    assert newest == {(1, 4), (2, 2)}
    cursors = {r["type"]: r["v"] for r in log.read().groupBy("type").agg(F.max("version").alias("v")).collect()}
    assert cursors == {"A": 9, "B": 4, None: 2}


@pytest.mark.parametrize("fan", [2, 8])
def test_ledgers_fold_without_changing_totals(spark, tmp_path, fan):
    entry = "consignment_id bigint, type string, status string, deleted_at string, version bigint, date date, pid bigint, count bigint, received bigint"
    state = ledger.ConsignmentLedger(spark, str(tmp_path / "c"))
    state.log.fan = state.dates.fan = fan
    day = dt.date(2025, 5, 1)
    for n in range(5):
        lines = [(n % 3, "SUPPLIER", "SENT", None, n, day + dt.timedelta(n), 1, n + 1, n), (9, "RETURN", "SENT", None, 100 - n, day, 2, 1, 0)]
        state.process(spark.createDataFrame(lines, entry), n)
    got = {(r["consignment_id"], r["qty_ordered"]) for r in state.entries().filter("type = 'SUPPLIER'").collect()}
    assert got == {(0, 4), (1, 5), (2, 3)}
    assert state.floor().scalar() is not None and state.floor().first()["date"] == day
    assert {r["type"]: r["version"] for r in state.cursors().collect()} == {"SUPPLIER": 4, "RETURN": 100}
