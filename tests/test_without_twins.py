"""The core's queries that no SQL repeats, over the whole smallest tables, against other ways to the same rows."""

import difflib
import math

import pandas as pd
import pytest

from conftest import DATA

from quotemill.functions import titles
from quotemill.operators import units
from quotemill.plans import cleaning, reference


def test_profile_equals_pandas(spark):
    quotes = pd.read_parquet(f"{DATA}/market_quotes.parquet")
    found = {(r["load_id"], r["source"], r["column_name"]): r for r in cleaning.p1_profile(spark, DATA).collect()}
    for (load, source), rows in quotes.groupby(["load_id", "source"]):
        for c in ("price", "implied_prob", "spread"):
            v, r = rows[c].dropna(), found[load, source, c]
            assert (r["n_rows"], r["n_values"], r["n_distinct"]) == (len(rows), len(v), v.nunique())
            if len(v):
                assert r["mean"] == pytest.approx(v.mean()) and r["stddev"] == pytest.approx(v.std(ddof=0), abs=1e-9)
                assert (float(r["min_value"]), float(r["max_value"])) == (v.min(), v.max())
            others = quotes[(quotes["source"] == source) & (quotes["load_id"] != load)][c].dropna()
            if len(v) and others.std(ddof=0) > 0:
                assert r["std_diff"] == pytest.approx((v.mean() - others.mean()) / others.std(ddof=0), rel=1e-6, abs=1e-9)
        r = found[load, source, "outcome"]
        assert (r["min_value"], r["max_value"]) == (rows["outcome"].min(), rows["outcome"].max())


def test_formats_add_up(spark):
    told = cleaning.p3_formats(spark, DATA).toPandas()
    counts = cleaning.p3_counts(spark, DATA).toPandas()
    assert told["n"].sum() == counts["n"].sum() and told[told["time_status"] == "resolved"]["n"].sum() == counts["n_resolved"].sum()
    sure = told[told["time_status"] == "resolved"]["least_posterior"]
    assert (sure >= 0.9).all() and told[told["time_status"] == "no instant"]["time_format"].isna().all()


def test_distances_are_those_of_the_names(spark):
    names = [r["known"] for r in units.dictionary(spark).collect()]
    for r in cleaning.p7_distances(spark, DATA).collect():
        words = units.parts(r["spelling"])[0]
        assert r["known"] in names and r["shared"] >= 1 and r["distance"] == pytest.approx(units.apart(words, r["known"]), abs=1e-4)


def test_ratios_equal_the_standard_library(spark):
    pairs = pd.read_parquet(f"{DATA}/candidate_pairs.parquet").set_index("pair_id")
    texts = sorted({*pairs["title_a"], *pairs["title_b"]})
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    joined = {r["t"]: " ".join(r["k"]) for r in df.select("t", titles.tokens(df["t"]).alias("k")).collect()}
    for r in reference.seq_ratio_pairs(spark, DATA).collect():
        a, b = (joined[pairs.at[r["pair_id"], c]] for c in ("title_a", "title_b"))
        assert r["ratio"] == pytest.approx(difflib.SequenceMatcher(None, a, b).ratio(), abs=1e-6)


def test_events_hold_every_market_once(spark):
    listed = [r["key"] for r in reference._listed(spark, DATA).filter("length(title) > 0").collect()]
    events, pairs = reference.resolve_events(spark, DATA).toPandas(), reference.resolve_pairs(spark, DATA).toPandas()
    assert sorted(events["key"]) == sorted(listed)
    of = dict(zip(events["key"], events["event_id"]))
    matched = pairs[pairs["decision"] == "match"]
    assert all(of[a] == of[b] for a, b in zip(matched["a"], matched["b"])) and (pairs["a"] < pairs["b"]).all()
    single = events[events["match_method"] == "singleton"]["key"]
    assert not set(single) & ({*matched["a"]} | {*matched["b"]})
    assert all(of[k] not in set(events[events["key"] != k]["event_id"]) for k in single)
    assert not any(math.isnan(c) for c in pairs["confidence"])
