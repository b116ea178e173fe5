"""Feeds into the lake: answers of keyword searches merged by id, runs over several sources, and outcomes looked up one by one."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.operators.latest import latest_row
from quotemill.session import Stored
from quotemill.sources import lake, venues

#: Fixed value: the snapshot of records that come from saved answers.
SAVED = "2025-01-01T00:00:00Z"


def listed(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """The items of answers that are JSON arrays: the other columns of answers, item (JSON). Damaged answers give none."""
    others = [c for c in answers.columns if c != answer]
    return answers.select(*others, F.explode(F.from_json(answer, "array<string>")).alias("item"))


def nested(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """Likewise the markets of search answers that nest them as events[].markets[]."""
    others = [c for c in answers.columns if c != answer]
    events = answers.select(*others, F.explode(F.from_json(answer, "events array<struct<markets:array<string>>>")["events"]).alias("e"))
    return events.select(*others, F.explode("e.markets").alias("item"))


def merged(items: DataFrame, order: Iterable[str], item: str = "item") -> DataFrame:
    """One item for each id that several keywords found, the last in order: id, item. Items without an id are left out; the text of the item breaks ties."""
    rows = items.select(F.get_json_object(item, "$.id").alias("id"), *order, item).filter("id is not null")
    return latest_row(rows, ["id"], [*[F.desc(c) for c in order], F.desc(item)]).select("id", item)


def records(items: DataFrame, source: str, snapshot: Column | None = None, id_: str = "id", item: str = "item") -> DataFrame:
    """Items as raw records of a snapshot (by default that of saved answers)."""
    if not source:
        raise ValueError("a source needs a name")
    at = snapshot if snapshot is not None else F.lit(SAVED).cast("timestamp")
    return items.select(F.lit(source).alias("source"), F.col(id_).cast("string").alias("market_id"), at.alias("snapshot_ts"), F.col(item).alias("payload"))


def ingest(spark: SparkSession, root: str, feeds: dict[str, Callable[[], DataFrame]], only: str = "all", live: bool = True) -> DataFrame:
    """Runs one feed or all: raw records and their quotes land in the lake. A row a source: source, n_raw, n_quotes, failed (null or why).

    Each feed gives raw records. On a live run a source that fails is reported and the others go on;
    otherwise its error is raised. Records that are read twice are read from the lake.
    """
    if only != "all" and only not in feeds:
        raise ValueError(f"unknown source {only!r}, known are {', '.join(feeds)} or 'all'")
    out = []
    for name in feeds if only == "all" else [only]:
        try:
            raw = feeds[name]().persist()
            try:
                quotes = venues.quotes(raw)
                lake.merge_raw(raw, root)
                lake.merge_quotes(quotes, root)
                out.append((name, raw.count(), quotes.count(), None))
            finally:
                raw.unpersist()
        except Exception as e:
            if not live:
                raise
            out.append((name, 0, 0, f"{type(e).__name__}: {e}"[:500]))
    return spark.createDataFrame(out, "source string, n_raw bigint, n_quotes bigint, failed string")


def outcome(source: Column, answer: Column) -> Column:
    """1 or 0 where a venue's answer about one market says that it ended yes or no, else null (open, damaged, or a venue without such answers)."""
    at = lambda path: F.lower(F.get_json_object(answer, path))
    ended = F.when(source == "kalshi", at("$.market.result")).when((source == "manifold") & (at("$.isResolved") == "true"), at("$.resolution"))
    return F.when(ended == "yes", 1).when(ended == "no", 0)


def look_up(log: DataFrame, known: DataFrame | None, ask: Callable[[str, str], str | None]) -> DataFrame:
    """Outcomes of logged markets that aren't known yet: source, market_id, outcome (null while open).

    Each market of the two venues that answer is asked for once, in the tasks that hold it; ask(source,
    market_id) gives the venue's answer or null, and an error of one market leaves it open. Store the result
    before it is used twice, so that nothing is asked again.
    """
    todo = log.filter(F.col("source").isin("kalshi", "manifold")).select("source", "market_id").distinct()
    if known is not None:
        todo = todo.join(known.select("market_id"), "market_id", "left_anti")

    def answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(source: str, market: str) -> str | None:
            try:
                return ask(source, market)
            except Exception:  # noqa: BLE001 - it is asked for again in the next run
                return None

        for batch in batches:
            yield batch.assign(answer=[one(s, m) for s, m in zip(batch["source"], batch["market_id"])])

    asked = todo.select("source", "market_id").mapInPandas(answers, "source string, market_id string, answer string")
    return asked.select("source", "market_id", outcome(F.col("source"), F.col("answer")).alias("outcome"))


def auto_resolve(spark: SparkSession, log: DataFrame, path: str, ask: Callable[[str, str], str | None]) -> tuple[int, int]:
    """Puts the outcomes of logged markets that have ended since the last run into the outcomes at path: (asked for, newly known)."""
    found = Stored(look_up(log, lake.resolutions(spark, path) if lake.exists(spark, path) else None, ask))
    try:
        checked, new = found.df.count(), found.df.filter("outcome is not null")
        n = new.count()
        if n:
            lake.upsert_outcomes(spark, new, path)
        return checked, n
    finally:
        found.drop()
