"""Weather forecasts: payloads of periods read into daily highs, and the place that a title is about."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Places with a forecast, in order of precedence, and the words that name each in a title.
PLACES = {
    "NYC": ["nyc", "new york"], "CHICAGO": ["chicago"], "DENVER": ["denver"], "MIAMI": ["miami"], "LOS_ANGELES": ["los angeles", "la"], "PHOENIX": ["phoenix"], "DALLAS": ["dallas"], "SEATTLE": ["seattle"], "ATLANTA": ["atlanta"],
    "BOSTON": ["boston"], "SAN_FRANCISCO": ["san francisco"], "HOUSTON": ["houston"], "PHILADELPHIA": ["philadelphia"], "LAS_VEGAS": ["las vegas"], "MINNEAPOLIS": ["minneapolis"], "AUSTIN": ["austin"], "NEW_ORLEANS": ["new orleans"], "SAN_ANTONIO": ["san antonio"],
}
#: A forecast page; what else it holds isn't read.
PAYLOAD = "properties struct<periods:array<struct<number:int,name:string,startTime:string,isDaytime:boolean,temperature:double,temperatureUnit:string>>>"
#: The page that a point is looked up on, which names the forecast's address.
POINT = "properties struct<forecast:string>"


def place(title: Column, places: dict[str, list[str]] | None = None) -> Column:
    """The first place in order of the dictionary with one of its names as whole words in the title; null for none.

    The dictionary is small and fixed, so the regex join with it is a chain of conditions beside each row.
    """
    out = F.when(F.lit(False), F.lit(""))
    for name, words in (places or PLACES).items():
        out = out.when(F.lower(title).rlike(r"\b(?:" + "|".join(map(re.escape, words)) + r")\b"), F.lit(name))
    return out


def forecast_address(payload: Column) -> Column:
    """First hop: the address of a point's forecast; null where the page is damaged or names none."""
    return F.from_json(payload, POINT)["properties"]["forecast"]


def highs(pages: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ("location",)) -> DataFrame:
    """Second hop: a row for each daytime period of a page: the columns of keep, day (yyyy-MM-dd, the first ten characters of its start), high_f, ordinal (its place on the page).

    Damaged pages and pages without periods give no rows, nor do periods without a temperature.
    """
    periods = pages.select(*keep, F.posexplode(F.from_json(payload, PAYLOAD)["properties"]["periods"]).alias("ordinal", "p"))
    return periods.filter("p.isDaytime and p.temperature is not null").select(*keep, F.substring("p.startTime", 1, 10).alias("day"), F.col("p.temperature").alias("high_f"), "ordinal")
