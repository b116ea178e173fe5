"""Packed fields of the tables against the parsers of the standard library."""

import ast
import csv
import io
import json
import os

import pytest

from quotemill.plans import cleaning

from conftest import DATA


def _parsed(text):
    """The values of a text by json, ast and csv, tried in turn."""
    if text is None or not text.strip():
        return []
    t = text.strip()
    if t.startswith('"['):
        t = json.loads(t)
    if t.startswith("["):
        try:
            return [str(x).strip() for x in json.loads(t)]
        except ValueError:
            return [str(x).strip() for x in ast.literal_eval(t)]
    bare = "".join(piece for i, piece in enumerate(t.split('"')) if i % 2 == 0)
    for d in ("||", "|", ";", "\t", "\n"):
        if d in bare:
            parts = [x.strip() for x in t.split(d)]
            return parts[:-1] if parts[-1] == "" else parts
    parts = [x.strip() for x in next(csv.reader(io.StringIO(t), skipinitialspace=True))]
    return parts[:-1] if parts[-1] == "" and t.endswith(",") else parts


@pytest.mark.parametrize("folder", [DATA, *(p for p in [DATA.replace("0.001", "0.01")] if os.path.isdir(p))])
def test_p4_equals_standard_parsers(spark, folder):
    expected = set()
    for table, field, rule in (("polymarket_markets", "outcomes", "true"), ("polymarket_markets", "outcomeprices", "true"), ("kalshi_markets", "title", "market_type = 'multi'")):
        for r in spark.read.parquet(f"{folder}/{table}.parquet").filter(rule).select("rec_id", field).collect():
            expected |= {(table, r["rec_id"], field, i, v) for i, v in enumerate(_parsed(r[field]), 1)}
    got = {tuple(r) for r in cleaning.p4_found(spark, folder).collect()}
    assert got == expected
