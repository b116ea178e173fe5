"""Timestamps in mixed notations against the standard library, and their edge cases."""

import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from quotemill.operators import instants

NY = "America/New_York"


def _read(spark, texts, zone=NY, order="mdy"):
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], "i int, t string, posterior string, _row string")
    out = instants.normalise(df, F.col("t"), F.lit("s"), F.lit(zone), F.lit(order))
    return {r["t"]: (r["utc_micros"], r["time_status"]) for r in out.collect()}


def _us(*a, zone="UTC", micro=0, fold=0):
    return int(dt.datetime(*a, tzinfo=ZoneInfo(zone), fold=fold).timestamp()) * 1_000_000 + micro


CASES = {
    "2021-03-20T04:59:00Z": _us(2021, 3, 20, 4, 59), "2021-03-20t04:59:00z": _us(2021, 3, 20, 4, 59), " 2021-03-20T04:59Z\t": _us(2021, 3, 20, 4, 59),
    "2021-03-24T04:59:00.000000999Z": _us(2021, 3, 24, 4, 59), "2021-03-24T04:59:00,565Z": _us(2021, 3, 24, 4, 59, micro=565_000), "2021-03-20T02:59:09-04:00": _us(2021, 3, 20, 6, 59, 9),
    "2021-03-18T02:59:00-04:00[America/New_York]": _us(2021, 3, 18, 6, 59), "2021-03-21 23:59:00 America/New_York": _us(2021, 3, 22, 3, 59), "2021-03-14 04:59:00 UTC": _us(2021, 3, 14, 4, 59),
    "2021-03-24 19:59:00": _us(2021, 3, 24, 23, 59), "1615852744402": 1615852744402000, "1615697967": 1615697967000000, "1616821140000000": 1616821140000000, "1615607940000000149": 1615607940000000,
    "1615593540.5": 1615593540500000, "Mon, 15 Mar 2021 19:59:39 -0400": _us(2021, 3, 15, 23, 59, 39), "03/17/2021 01:59": _us(2021, 3, 17, 5, 59), "Mar 20, 2021 7:59 PM EDT": _us(2021, 3, 20, 23, 59),
    "Mar 13, 2021 12:59 AM EST": _us(2021, 3, 13, 5, 59), "24 March 2021, 23:59": _us(2021, 3, 25, 3, 59), "20210819T230000Z": _us(2021, 8, 19, 23), "2021-04-30 08:05:00+0100": _us(2021, 4, 30, 7, 5),
    "Aug 13, 2021 8:40 PM BST": _us(2021, 8, 13, 19, 40),
    # A skipped hour moves forward by the gap, a repeated one means its first pass.
    "2021-03-14 02:30:00": _us(2021, 3, 14, 7, 30), "2021-11-07 01:30:00": _us(2021, 11, 7, 5, 30),
}
NOTHING = ["", "soon", "TBD", "null", "-", "0000-00-00 00:00:00", "2021-13-45T25:61:00Z", "2021-02-30 10:00:00", "2021-03-20", "13:05 PM", "2021-03-20 10:00:00 Nowhere/City", "x" * 100_000, None]


def test_known_notations(spark):
    got = _read(spark, list(CASES))
    assert {t: got[t][0] for t in CASES} == CASES
    assert {s for _, s in got.values()} == {"resolved"}


def test_what_names_no_instant(spark):
    got = _read(spark, NOTHING)
    assert all(v == (None, "no instant") for v in got.values()), got


def test_declared_order_decides_and_impossible_order_gives_way(spark):
    got = _read(spark, ["03/04/2021 10:00", "25/03/2021 10:00"], "UTC", "mdy")
    assert got["03/04/2021 10:00"][0] == _us(2021, 3, 4, 10) and got["25/03/2021 10:00"][0] == _us(2021, 3, 25, 10)
    assert _read(spark, ["03/04/2021 10:00"], "UTC", "dmy")["03/04/2021 10:00"][0] == _us(2021, 4, 3, 10)


def test_mixture_learns_the_order_or_says_it_is_open(spark):
    clear = [f"{d}/03/2021 10:00" for d in range(13, 29)]
    got = _read(spark, [*clear, "03/04/2021 10:00"], "UTC", None)
    assert got["03/04/2021 10:00"] == (_us(2021, 4, 3, 10), "resolved")
    assert _read(spark, ["03/04/2021 10:00"], "UTC", None)["03/04/2021 10:00"] == (None, "ambiguous")


def test_rows_and_columns_stay(spark):
    df = spark.createDataFrame([(1, "2021-01-01T00:00:00Z", "a"), (1, "2021-01-01T00:00:00Z", "a"), (None, None, None)], "i int, t string, utc_micros string")
    out = instants.normalise(df, F.col("t"), F.lit("s"), F.lit("UTC"))
    assert out.count() == 3 and out.columns == ["i", "t", "utc_micros", "time_format", "posterior", "time_status"]
    assert instants.normalise(df.limit(0), F.col("t"), F.lit("s"), F.lit("UTC")).count() == 0


@pytest.mark.parametrize("zone", ["America/New_York", "Australia/Sydney", "Asia/Kolkata", "Europe/Berlin"])
def test_local_times_round_trip(spark, zone):
    base = dt.datetime(2021, 1, 1, 3, 17, 5, tzinfo=dt.timezone.utc)
    moments = [base + dt.timedelta(hours=37 * i) for i in range(230)]
    texts = {m.astimezone(ZoneInfo(zone)).strftime("%Y-%m-%d %H:%M:%S"): m for m in moments if m.astimezone(ZoneInfo(zone)).fold == 0}
    got = _read(spark, list(texts), zone, None)
    for t, m in texts.items():
        assert got[t][0] == int(m.timestamp()) * 1_000_000
