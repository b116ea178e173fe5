"""How far each quote of an event is from what the others say."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.columns import without


def leave_one_out(quotes: DataFrame, event: str = "event_id", source: str = "source", p: str = "implied_prob", places: int = 6) -> DataFrame:
    """Quotes of events that several sources quote, with n_quotes, n_sources, consensus (mean of the event's other quotes), dispersion (population deviation), deviation and abs_deviation.

    Event sums are map-side reduced aggregates and joined back, so a hot event is no hot task; events of
    one source are dropped before the join. Null events and null or NaN probabilities take no part.
    """
    rows = without(quotes, "n_quotes", "n_sources", "dispersion", "consensus", "deviation", "abs_deviation", "_sum").filter(F.col(event).isNotNull() & F.col(p).isNotNull() & ~F.isnan(p))
    per = rows.groupBy(event).agg(F.count("*").alias("n_quotes"), F.count_distinct(source).alias("n_sources"), F.sum(p).alias("_sum"), F.coalesce(F.stddev_pop(p), F.lit(0.0)).alias("dispersion")).filter("n_sources > 1")
    consensus = (F.col("_sum") - F.col(p)) / F.nullif(F.col("n_quotes") - 1, F.lit(0))
    out = rows.join(per, event).withColumn("consensus", consensus)
    rounded = {c: F.round(x, places) for c, x in (("consensus", F.col("consensus")), ("deviation", F.col(p) - F.col("consensus")), ("abs_deviation", F.abs(F.col(p) - F.col("consensus"))), ("dispersion", F.col("dispersion")))}
    return out.withColumns(rounded).drop("_sum")


def margin_free(odds: DataFrame, event: str, outcome: str, price: str, least: int = 2) -> DataFrame:
    """Fair probabilities of an event's outcomes: event, outcome, fair_prob, n_books. Decimal prices above 1 count; each outcome's mean of 1/price over its books is divided by the event's sum. Events with fewer than `least` outcomes are dropped."""
    implied = odds.filter(F.col(price) > 1).groupBy(event, outcome).agg(F.avg(1 / F.col(price)).alias("q"), F.count("*").alias("n_books"))
    w = Window.partitionBy(event)  # an event's outcomes are few
    return implied.withColumns({"_all": F.sum("q").over(w), "_n": F.count("*").over(w)}).filter(F.col("_n") >= least).select(event, outcome, (F.col("q") / F.col("_all")).alias("fair_prob"), "n_books")
