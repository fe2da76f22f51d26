"""Means and heights that lie halfway between two decimals equal SQL: one step there moves an event by a millisecond."""

import os
import random
from datetime import datetime, timedelta

import compare
import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from ebbflow.plans import catalog


@pytest.fixture(scope="module")
def ties(sf, tmp_path_factory):
    """The tables with other events: 32 readings of an hour whose mean ends in ...5, their sum a bit short of it."""
    at = tmp_path_factory.mktemp("ties")
    for t in compare.TABLES:
        if t != "events":
            os.symlink(f"{sf}/{t}.parquet", at / f"{t}.parquet")
    r = random.Random(32)
    hours = [[23.43], [r.randrange(0, 2000) / 100 for _ in range(32)], [30.94], [20.0], [25.0]]
    db = duckdb.connect()
    db.execute("CREATE TABLE e (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    rows = [(datetime(2024, 1, 1, h, k), v) for h, values in enumerate(hours) for k, v in enumerate(values)]
    for k, (ts, v) in enumerate(rows):
        db.execute("INSERT INTO e VALUES (?, ?, 1, 'click', ?, '{}')", [k, ts, v])
    # a parabola whose vertex is 31.51835 high
    for k, v in enumerate([28.62, 30.3, 16.23, 20.0]):
        db.execute("INSERT INTO e VALUES (?, ?, 1, 'view', ?, '{}')", [100 + k, datetime(2024, 1, 1) + timedelta(hours=k), v])
    # an event 24.0499025 years after 2000
    for k, v in enumerate([35.49, 5.93, 7.64]):
        db.execute("INSERT INTO e VALUES (?, ?, 1, 'error', ?, '{}')", [200 + k, datetime(2024, 1, 19, 4) + timedelta(hours=k), v])
    db.execute(f"COPY (SELECT * FROM e ORDER BY event_id) TO '{at}/events.parquet' (FORMAT parquet)")
    return str(at)


def same_rows(spark, ties, name, port):
    columns, rows = compare.spark_rows(catalog.QUERIES[name](spark, ties))
    expected, wanted = compare.sql_rows(ties, catalog.SQL[name])
    of_port = lambda found: [r for r in found if port in r]
    assert columns == expected and of_port(rows) == of_port(wanted) and of_port(rows)
    return of_port(rows)


def test_hourly_mean(spark, ties):
    assert any(9.061563 in r for r in same_rows(spark, ties, "hourly_series", "click"))


def test_state_alternation(spark, ties):
    same_rows(spark, ties, "state_alternation", "click")


def test_turning_points(spark, ties):
    same_rows(spark, ties, "turning_points", "click")
    assert any(31.5184 in r for r in same_rows(spark, ties, "turning_points", "view"))


def test_calibrated_identity(spark, ties):
    same_rows(spark, ties, "calibrated_identity", "click")


def test_event_features(spark, ties):
    same_rows(spark, ties, "event_features", "click")
    assert any(24.049903 in r for r in same_rows(spark, ties, "event_features", "error"))


@pytest.mark.parametrize("port", ["click", "view"])
def test_turning_points_bucketed(spark, ties, port):
    same_rows(spark, ties, "turning_points_bucketed", port)


@pytest.fixture(scope="module")
def groups(sf, tmp_path_factory):
    """(tables, the same with a reading an hour): events in two equal row groups, and the means of their sums by group.

    An hour of 32 readings has 8.2128125 on average: added in one go it rounds down, by group up.
    """
    path = tmp_path_factory.mktemp("row groups") / "100%"
    path.mkdir()
    r = random.Random(8)
    hours = [[23.43], [r.randrange(0, 2000) / 100 for _ in range(32)], [21.49], [20.0], [25.0]]
    rows = [(datetime(2024, 1, 1, h, k), v) for h, values in enumerate(hours) for k, v in enumerate(values)]
    whole, means = path / "whole", path / "means"
    for at, ts, values in ((whole, [t for t, _ in rows] * 2, [v for _, v in rows] * 2), (means, [datetime(2024, 1, 1, h) for h in range(5)], [(total(v) + total(v)) / (2 * len(v)) for v in hours])):
        at.mkdir()
        for t in compare.TABLES:
            if t != "events":
                os.symlink(f"{sf}/{t}.parquet", at / f"{t}.parquet")
        n = len(ts)
        events = pa.table({"event_id": range(n), "ts": pa.array(ts, pa.timestamp("us")), "user_id": [1] * n, "event_type": ["click"] * n, "value": values, "props": ["{}"] * n})
        pq.write_table(events, at / "events.parquet", row_group_size=len(rows))
    return str(whole), str(means)


def total(values):
    out = 0.0
    for v in values:
        out += v
    return out


def same_in_any_split(spark, groups, name):
    """The query's rows by splits of one and of two row groups, equal to its SQL on the means by group."""
    whole, means = groups
    expected = compare.sql_rows(means, catalog.SQL[name])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("128m", "800b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert compare.spark_rows(catalog.QUERIES[name](spark, whole)) == expected and expected[1]
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    return expected[1]


def test_calibrated_identity_by_row_group(spark, groups):
    same_in_any_split(spark, groups, "calibrated_identity")


def test_turning_points_bucketed_by_row_group(spark, groups):
    assert any("2024-01-01T01:02:02.551000" in r for r in same_in_any_split(spark, groups, "turning_points_bucketed"))
