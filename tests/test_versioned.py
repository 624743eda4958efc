"""Versioned tables: whole old or whole new content, whatever stops a publish."""

import pytest

from retailflow.operators.versioned import Conflict, VersionedTable

SCHEMA = "v bigint, season string"


def content(table, version=None):
    return sorted(map(tuple, table.read(version).collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    made = VersionedTable(spark, str(tmp_path / "rows"), "season")
    made.publish(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], SCHEMA), note="scan")
    return made


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def test_partitions_are_replaced_and_emptied(spark, table):
    table.publish(rows(spark, (9, "b"), (8, "odd/name=x")), ["b"])
    assert content(table) == [(1, "a"), (3, None), (8, "odd/name=x"), (9, "b")]
    table.publish(rows(spark).filter("false"), ["b", "odd/name=x"])
    assert content(table) == [(1, "a"), (3, None)]
    assert content(table, 0) == [(1, "a"), (2, "b"), (3, None)]


def test_a_publish_may_stop_between_any_two_writes(spark, table, monkeypatch):
    old = content(table)

    def stop(*_):
        raise RuntimeError("lost")

    # before any data, after data, and with a manifest written aside
    for name in ("_write", "_commit"):
        with monkeypatch.context() as patch, pytest.raises(RuntimeError):
            patch.setattr(VersionedTable, name, stop)
            table.publish(rows(spark, (7, "a")), ["a"])
        assert content(table) == old
    aside = f"{table.path}/manifest/_1.tmp"
    open(aside, "w").write("{half")
    assert content(table) == old and table.versions() == [0]
    # the next writer takes the same number and replaces what was left
    table.publish(rows(spark, (7, "a")), ["a"])
    assert content(table) == [(2, "b"), (3, None), (7, "a")]


def test_reverting_moves_the_manifest_only(spark, table):
    first = content(table)
    table.overwrite(table.read().filter("v > 1"), note="cut")
    assert content(table) == [(2, "b"), (3, None)]
    table.revert(0)
    assert content(table) == first and table.versions() == [0, 1, 2]
    assert [tuple(r) for r in table.journal().select("version", "note").collect()] == [(0, "scan"), (1, "cut"), (2, "revert to 0")]


def test_two_writers_of_one_version(spark, table):
    table._commit(1, table.manifest(0) | {"note": "other"})
    with pytest.raises(Conflict):
        table._commit(1, table.manifest(0))
    assert table.manifest(1)["note"] == "other"


def test_vacuum_keeps_what_versions_name(spark, table):
    table.publish(rows(spark, (5, "a")), ["a"])
    table.publish(rows(spark, (6, "a")), ["a"])
    table.vacuum(1)
    assert table.versions() == [2] and content(table) == [(2, "b"), (3, None), (6, "a")]
    import os

    assert sorted(os.listdir(f"{table.path}/data")) == ["v0", "v2"]
