"""Every query against its SQL twin in DuckDB, and the core without the text package."""

import glob
import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

from conftest import DATA

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def _plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kind = str(df[c].dtype)
        if kind.startswith("datetime"):
            df[c] = pd.to_datetime(df[c], utc=True).dt.tz_localize(None).astype("datetime64[us]").astype(str)
        elif kind != "object":
            df[c] = df[c].astype(float)
    df = df.astype(str).replace({"nan": "None", "NaT": "None", "<NA>": "None", "True": "1.0", "False": "0.0"})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    ours, theirs = entry.queries()[name](spark, DATA).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    pd.testing.assert_frame_equal(_plain(ours), _plain(theirs))


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_runs(spark, name):
    df = entry.queries()[name](spark, DATA)
    assert df.count() > 0 and len(df.columns) == len(set(df.columns))


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_core_stands_without_the_text_package():
    code = "import sys, importlib.util as u; f = u.find_spec; u.find_spec = lambda n, *a: None if n.startswith('quotemill.llm') else f(n, *a); import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p5_found' not in q; assert not [m for m in sys.modules if m.startswith('quotemill.llm')]"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_command_line(spark, capsys):
    from quotemill import __main__ as cli

    assert cli.main(["list"]) == 0 and "latest_per_key" in capsys.readouterr().out
    assert cli.main(["run", "nothing", DATA]) == 2
    assert cli.main(["run", "kpis", DATA]) == 0 and cli.main(["explain", "kpis", DATA]) == 0
    assert cli.main(["doctor"]) == 0
