"""Results of queries written as tables, and the order in which those that need others are made."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.session import scope

#: Staged queries stay views, the others become tables.
VIEWS = ("stage_events", "union_sources", "quotes_with_event")
#: What must be made before each: the log of quotes, their scores, and what is measured on them.
AFTER = {"score_quotes": ("append_log",), "calibration10": ("score_quotes",), "brier_group": ("score_quotes",), "alerts": ("loo_consensus",), "diagnostics_reasons": ("resolve_events",)}

#: The order in which readers get a table, '-' for descending; nulls come last. Files keep no order, so it is made at reading.
ORDER = {"loo_consensus": ["-abs_deviation", "row_id"], "forecast_edges": ["-forecast_prob", "row_id"], "calibration10": ["prob_bucket"], "calibration5": ["prob_bucket"], "brier_group": ["-n", "series"], "quality_scores": ["source"], "resolve_pairs": ["-confidence", "a", "b"], "alerts": ["-gap", "label"]}


def ordered(names: Iterable[str], after: dict[str, tuple[str, ...]] | None = None) -> list[str]:
    """The names with all that they need, each after what it needs; ValueError for a circle."""
    needs, out, under_way = AFTER if after is None else after, [], []

    def visit(name: str) -> None:
        if name in out:
            return
        if name in under_way:
            raise ValueError("circle: " + " -> ".join([*under_way, name]))
        under_way.append(name)
        for n in needs.get(name, ()):
            visit(n)
        under_way.pop()
        out.append(name)

    for name in names:
        visit(name)
    return out


def materialise(spark: SparkSession, queries: dict[str, Callable[[SparkSession, str], DataFrame]], names: Iterable[str], folder: str, root: str) -> dict[str, str]:
    """Makes the named results and what they need: tables as Parquet in root/marts/NAME, staged ones as temporary views. Name and place of each.

    A table is written even if it is empty, with its columns, so that readers always find it.
    """
    made = {}
    for name in ordered(names):
        with scope():
            df = queries[name](spark, folder)
            if name in VIEWS:
                df.createOrReplaceTempView(name)
                made[name] = f"view {name}"
            else:
                path = f"{root}/marts/{name}"
                df.write.mode("overwrite").parquet(path)
                made[name] = path
    return made


def read(spark: SparkSession, root: str, name: str, most: int | None = None) -> DataFrame | None:
    """A table that was made, in its ORDER (by the columns of it that the table has), the first `most` rows of it if that is given; None where it never was made. Any other error is raised."""
    from quotemill.sources.lake import exists

    path = f"{root}/marts/{name}"
    if not exists(spark, path):
        return None
    rows = spark.read.parquet(path)
    order = [F.desc_nulls_last(c[1:]) if c.startswith("-") else F.asc_nulls_last(c) for c in ORDER.get(name, []) if c.lstrip("-") in rows.columns]
    rows = rows.orderBy(*order) if order else rows
    return rows if most is None else rows.limit(most)
