"""Streams that wait, and flags as of a moment of the day."""

import datetime

from pyspark.sql import functions as F
from test_streaming import drained, landed  # noqa: F401

from newsloom.operators import reference
from newsloom.streaming import timers

S = 1_000_000_000
MS = 1_000_000


def test_packets_in_order(spark, landed, tmp_path):  # noqa: F811
    at = lambda ms: 10**18 + ms * MS
    packets = [
        ("a", 1, 2, at(0), "p1"), ("a", 5, 1, at(10), "p5"), ("a", 3, 2, at(20), "p3"), ("a", 3, 2, at(30), "again"), ("a", 4, 3, at(40), "p4"), ("a", 9, 1, at(50), "p9"), ("a", 12, 1, at(60), "p12"),
        ("a", 7, 2, at(2000), "too late"), ("a", 13, 1, at(2010), "p13"), ("b", 100, 1, at(15), "q"), ("b", 103, 1, at(16), "r"), ("b", 101, 2, at(260), "s"), ("c", 1, 1, at(60_000), "clock"), ("a", 20, 1, at(3000), "p20"), ("c", 2, 1, at(90_000), "clock"),
    ]
    df = spark.createDataFrame(packets, "session string, seq long, n long, t long, body string")
    got = drained(timers.packets_in_order(landed(df, "t", parts=5), key="session", seq="seq", count="n", time_ns="t", payload="body"), tmp_path, "packets")
    rows = [tuple(r) for r in got.collect()]
    assert [r[1:] for r in rows if r[0] == "a"] == [(1, 2, 0, "p1"), (3, 2, 0, "p3"), (5, 1, 0, "p5"), (6, 1, 0, "p4"), (9, 1, 2, "p9"), (12, 1, 2, "p12"), (13, 1, 0, "p13"), (20, 1, 6, "p20")]
    assert [r[1:] for r in rows if r[0] == "b"] == [(100, 1, 0, "q"), (101, 2, 0, "s"), (103, 1, 0, "r")]


def test_horizon_outcomes(spark, landed, tmp_path):  # noqa: F811
    at = lambda s: 10**18 + s * S
    rows = [("A", "n1", at(0), None), ("A", None, at(-5), 100), ("A", None, at(30), 111), ("A", None, at(30), 110), ("A", None, at(60), 120), ("A", None, at(61), 130), ("A", "n2", at(50), None), ("B", "n3", at(1), None), ("A", None, at(400), 140), ("Z", None, at(1000), 1), ("Z", None, at(2000), 1)]
    x = landed(spark.createDataFrame(rows, "ticker string, id string, t long, px long").withColumn("print_id", F.when(F.col("px").isNotNull(), F.col("px") % 7)), "t", parts=5)
    out = timers.horizon_outcomes(x.where("px is null"), x.where("px is not null"), key="ticker", id_col="id", time_ns="t", print_ns="t", print_id="print_id", price="px", horizons_ns=[60 * S, 300 * S])
    got = sorted((tuple(r) for r in drained(out, tmp_path, "outcomes").collect()), key=str)
    assert got == [("n1", 300 * S, 130), ("n1", 60 * S, 111), ("n2", 300 * S, 130), ("n2", 60 * S, 130), ("n3", 300 * S, None), ("n3", 60 * S, None)]


def test_horizon_outcomes_keep_large_ids(spark, landed, tmp_path):  # noqa: F811
    at, big = (lambda s: 10**18 + s * S), 2**60 + 1
    rows = [("A", big, at(0), None, None), ("A", None, at(1), 100, big), ("A", None, at(1), 101, big + 1), ("Z", None, at(1000), 1, 0), ("Z", None, at(2000), 1, 0)]
    x = landed(spark.createDataFrame(rows, "ticker string, id long, t long, px long, print_id long"), "t", parts=3)
    out = timers.horizon_outcomes(x.where("px is null"), x.where("px is not null"), key="ticker", id_col="id", time_ns="t", print_ns="t", print_id="print_id", price="px", horizons_ns=[60 * S])
    assert [tuple(r) for r in drained(out, tmp_path, "large_ids").collect()] == [(big, 60 * S, 101)]


def test_flags_received_by_now(spark):
    d = lambda n: datetime.date(2026, 9, n)
    filings = spark.createDataFrame([(1, d(25), "s3", 100), (1, d(25), "s3", 90), (1, d(25), "424b", None), (1, d(24), "424b", 999), (1, d(26), "s1", 1), (2, d(25), "s1", 50)], "cik long, day date, kind string, recv long")
    asked = spark.createDataFrame([(1, d(25), 89), (1, d(25), 90), (1, d(26), 0), (2, d(25), 49), (2, d(25), 50), (3, d(25), 50)], "cik long, day date, now long")
    got = reference.flags_in_window(asked, filings, key="cik", asked_day="day", day="day", kind="kind", windows={"s3": (5, 1), "424b": (5, 2), "s1": (0, 4)}, asked_ns="now", received_ns="recv")
    assert sorted((r.cik, r.day.day, r.now, r.flags) for r in got.collect()) == [(1, 25, 89, 2), (1, 25, 90, 3), (1, 26, 0, 3), (2, 25, 49, 0), (2, 25, 50, 4), (3, 25, 50, 0)]
