"""Packed fields and units, by cases and round trips."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quotemill.operators import packed, units

CASES = {
    '["Yes", "No"]': ["Yes", "No"], "['Yes', 'No']": ["Yes", "No"], "Yes,No": ["Yes", "No"], "Yes; No;": ["Yes", "No"], "a||b||c": ["a", "b", "c"], "a | b |": ["a", "b"], "a\nb": ["a", "b"], "a\tb": ["a", "b"], "a\r\nb": ["a", "b"],
    '"[\\"6 pct\\", \\"0.1\\"]"': ["6 pct", "0.1"], '["\\"Captain\\" X", "O\'Y, by 2"]': ['"Captain" X', "O'Y, by 2"], '"""Captain"" X",Y': ['"Captain" X', "Y"], "['O\\'Y', '\"Captain\" X', \"O'Z\"]": ["O'Y", '"Captain" X', "O'Z"],
    'yes A, "no B, by 3", yes C': ["yes A", "no B, by 3", "yes C"], "X, by 2 or more|Y": ["X, by 2 or more", "Y"], "O'A,O'B": ["O'A", "O'B"], '"Captain" X|Y': ['"Captain" X', "Y"], "single": ["single"], "a,,b": ["a", "", "b"], '["a", ""]': ["a", ""],
    "[]": [], "": [], "  ": [], None: [], "[0.5, 0.5]": ["0.5", "0.5"],
}


def test_packed_cases(spark):
    df = spark.createDataFrame([(t,) for t in CASES], "t string")
    got = {r["t"]: r["i"] for r in df.select("t", packed.items(F.col("t")).alias("i")).collect()}
    assert got == CASES


def test_packed_round_trips_json(spark):
    rng = random.Random(2)
    lists = [["".join(rng.choice("ab,;|' \"") for _ in range(6)).strip() + "z" for _ in range(rng.randint(1, 5))] for _ in range(200)]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(lists)], "i int, t string")
    got = {r["i"]: r["x"] for r in df.select("i", packed.items(F.col("t")).alias("x")).collect()}
    assert [(got[i], x) for i, x in enumerate(lists) if got[i] != [v.strip() for v in x]] == []


def test_unpack_places_and_edge_rows(spark):
    df = spark.createDataFrame([(1, "a,b", "x", 9), (1, "a,b", "x", 9), (2, None, None, None), (3, ",".join(["v"] * 20_000), "y", 1)], "id int, t string, item string, pos int")
    out = packed.unpack(df, F.col("t"))
    assert out.columns == ["id", "t", "pos", "item"] and out.count() == 20_004
    assert [(r["pos"], r["item"]) for r in out.filter("id = 1").orderBy("pos").collect()] == [(1, "a"), (1, "a"), (2, "b"), (2, "b")]
    assert packed.unpack(df.limit(0), F.col("t")).count() == 0


@pytest.mark.parametrize("text,value,unit", [("22.33 cents", 22.33, "cents"), ("9.84¢", 9.84, "¢"), ("$0.35", 0.35, "$"), ("USD 0.05", 0.05, "usd"), ("5911 bps", 5911.0, "bps"), ("6%", 6.0, "%"), ("1,200 bps", 1200.0, "bps"), ("0.5", 0.5, ""), (".5 c", 0.5, "c")])
def test_quantities(spark, text, value, unit):
    r = spark.range(1).select(units.quantity(F.lit(text)).alias("q")).first()["q"]
    assert (r["value"], r["unit"]) == (value, unit)


def test_texts_without_one_number_have_no_quantity(spark):
    df = spark.createDataFrame([("",), (None,), ("abc",), ("1 2",), ("x" * 50_000,)], "t string")
    assert df.select(units.quantity(F.col("t")).alias("q")).filter("q is not null").count() == 0


def test_spellings_find_their_unit(spark):
    spelt = {"cents": "cent", "US cents": "cent", "cnets": "cent", "quoted in  cents": "cent", "c/share": "cent", "basis points": "basis_point", "basis ponits": "basis_point", "percnt": "percent", "moneyline": "american_odds", "Odds (Decimal)": "decimal_odds", "decimal-odds": "decimal_odds", "share price 0-1": "fraction", "furlongs": None}
    df = spark.createDataFrame([(s,) for s in spelt], "s string").select("s", units.clean(F.col("s")).alias("spelling"))
    found = {r["spelling"]: r["unit"] for r in units.aliases(df).collect()}
    assert {s: found.get(" ".join(s.lower().split())) for s in spelt} == spelt


def test_index_loses_no_near_name(spark):
    spelt = ["cnets", "odds decimal", "c/share", "prob", "us cent", "usd_cent", "dec", "quoted in cents", "1/100 of a percent", "1/3 of a cent", "basis ponits", "dollras", "moneylin", "pctt", "b p", "(0-1)", "share price (0 to 1)", "x" * 300, "a b c " * 40]
    df = spark.createDataFrame([(s,) for s in spelt], "s string").select(units.clean(F.col("s")).alias("spelling"))
    found = {r["spelling"]: r["distance"] for r in units.aliases(df).collect()}
    names = [(r["known"], r["unit"]) for r in units.dictionary(spark).collect()]
    for s in spelt:
        s = " ".join(s.split())
        words, by = units.parts(s)
        least = min(((units.apart(words, k), k) for k, _ in names), key=lambda x: x[0])
        near = least[0] <= units.MOST_APART * max(len(words), len(least[1])) and s != "1/3 of a cent"
        assert (s in found) == near and (not near or found[s] == pytest.approx(least[0])), s


def test_halves_go_to_the_even_millionth(spark):
    p = units.millionths(units.to_probability(F.col("v"), F.col("u")))
    rows = spark.createDataFrame([(5.12, "decimal_odds"), (412.0, "american_odds"), (-412.0, "american_odds"), (55.63, "cent")], "v double, u string").select("v", p.alias("m")).collect()
    assert {r["v"]: r["m"] for r in rows} == {5.12: 195312, 412.0: 195312, -412.0: 804688, 55.63: 556300}


def test_with_unit_keeps_rows_and_takes_defaults(spark):
    df = spark.createDataFrame([(1, "pct", "x"), (2, None, "x"), (3, " ", "x"), (4, "furlongs", "x"), (4, "furlongs", "x")], "id int, u string, _key string")
    out = units.with_unit(df, "u", F.lit("cent"))
    assert out.columns == ["id", "u", "_key", "unit"]
    assert sorted((r["id"], r["unit"]) for r in out.collect() if r["unit"]) == [(1, "percent"), (2, "cent"), (3, "cent")] and out.count() == 5
    assert units.with_unit(df.limit(0), "u", F.lit("cent")).count() == 0


@pytest.mark.parametrize("value,unit,p", [(50.0, "cent", 0.5), (25.0, "percent", 0.25), (120.0, "basis_point", 0.012), (4.0, "decimal_odds", 0.25), (300.0, "american_odds", 0.25), (-300.0, "american_odds", 0.75), (0.0, "american_odds", None), (0.5, "decimal_odds", None), (150.0, "cent", None), (0.4, "dollar", 0.4), (None, "cent", None), (1.0, "unknown", None)])
def test_probabilities(spark, value, unit, p):
    r = spark.range(1).select(units.to_probability(F.lit(value).cast("double"), F.lit(unit)).alias("p")).first()["p"]
    assert r == pytest.approx(p) if p is not None else r is None


@pytest.mark.parametrize("value,scale", [(0.5, "fraction"), (50.0, "percent"), (5000.0, "basis_point"), (1.5, None), (150.0, None), (-3.0, None), (None, None)])
def test_scales(spark, value, scale):
    assert spark.range(1).select(units.quoted_scale(F.lit(value).cast("double")).alias("s")).first()["s"] == scale
