"""Validity intervals of list entries: ends across hours, gaps by removal."""

from datetime import datetime, timedelta, timezone

from lexspan.llm import url_filter

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return START + timedelta(seconds=seconds)


def test_intervals_end_where_the_next_begins(spark):
    rows = [("a", "block", at(0)), ("a", "allow", at(10)), ("a", "remove", at(10_000)), ("a", "block", at(90_000)), ("b", "block", at(5)), ("b", "block", at(5))]
    entries = spark.createDataFrame(rows, "pattern string, action string, listed_at timestamp")
    zero = int(START.timestamp())
    got = sorted((r.pattern, r.valid_from - zero, r.action, r.valid_to and r.valid_to - zero) for r in url_filter.intervals(entries).collect())
    assert got == [("a", 0, "block", 10), ("a", 10, "allow", 10_000), ("a", 10_000, "remove", 90_000), ("a", 90_000, "block", None), ("b", 5, "block", None)]


def test_gap_after_a_removal_hours_ago(spark):
    entries = spark.createDataFrame([("x.org", "block", at(0)), ("x.org", "remove", at(4_000)), ("x.org", "allow", at(20_000))], "pattern string, action string, listed_at timestamp")
    times = [-1, 0, 3_999, 4_000, 4_001, 15_000, 19_999, 20_000, 500_000]
    captures = spark.createDataFrame([(t, "http://x.org/p", at(t)) for t in times], "t long, url string, fetched_at timestamp")
    got = {r.t: r.action for r in url_filter.judge(captures, entries).collect()}
    assert got == {-1: "none", 0: "block", 3_999: "block", 4_000: "none", 4_001: "none", 15_000: "none", 19_999: "none", 20_000: "allow", 500_000: "allow"}
