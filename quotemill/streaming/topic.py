"""Messages of a topic: encoding, normalising and landing them, as a stream that drains what is there and stops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.operators.dedup import keep_one
from quotemill.sources import lake, venues

MESSAGE = "source string, market_id string, snapshot_ts string, payload string"


def encode(raw: DataFrame) -> DataFrame:
    """Raw records as key (source:market_id) and value (JSON), as a topic takes them. A payload that is no JSON goes as a text."""
    stamp = F.date_format(F.col("snapshot_ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    body = F.to_json(F.struct("source", "market_id", stamp.alias("snapshot_ts"), "payload"))
    return raw.select(F.encode(F.concat_ws(":", "source", "market_id"), "UTF-8").alias("key"), F.encode(body, "UTF-8").alias("value"))


def decode(messages: DataFrame) -> DataFrame:
    """Raw records from values; damaged messages have null fields and their text in `damaged`."""
    text = F.col("value").cast("string")
    m = F.from_json(text, MESSAGE)
    parsed = messages.select(m.alias("m"), text.alias("text"))
    whole = F.col("m.source").isNotNull() & F.col("m.market_id").isNotNull() & F.try_to_timestamp(F.col("m.snapshot_ts")).isNotNull()
    return parsed.select("m.source", "m.market_id", F.try_to_timestamp(F.col("m.snapshot_ts")).alias("snapshot_ts"), "m.payload", F.when(~whole, F.col("text")).alias("damaged"))


def drain(source: DataFrame, checkpoint: str, land: Callable[[DataFrame, int], None]) -> int:
    """Runs a stream over all that is there now, batch by batch, and stops: the number of rows read. Started again with the same checkpoint it goes on where it ended."""
    query = source.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def land_quotes(root: str) -> Callable[[DataFrame, int], None]:
    """Lands a batch of decoded messages: quotes merged into the clean zone, raw records into the raw zone, damaged messages beside them. Safe to repeat."""

    def land(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # several passes over one micro-batch, whose size the source's limits bound
        try:
            batch.filter("damaged is not null").select("damaged").write.mode("overwrite").parquet(f"{root}/damaged/batch={number}")
            whole = batch.filter("damaged is null").drop("damaged")
            lake.merge_raw(whole, root)
            lake.merge_quotes(venues.quotes(whole), root)
        finally:
            batch.unpersist()

    return land


def windowed(events: DataFrame, ts: str, by: list[str], value: Column, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums by event-time window; state older than the watermark goes."""
    w = F.window(ts, window)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *by, "n", "total")


def once(spark: SparkSession, folder: str, schema: str, key: list[str], order: list[str], checkpoint: str, out: str, files: int = 1) -> DataFrame:
    """A folder of Parquet files replayed as a stream and landed with one copy of each key: every batch is merged with what is there."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)

    def land(batch: DataFrame, number: int) -> None:
        keep_one(batch, {k: F.col(k) for k in key}, order).write.mode("overwrite").parquet(f"{out}/batch={number}")

    if drain(stream, checkpoint, land) == 0 and not lake.exists(spark, out):
        return spark.createDataFrame([], schema)
    return keep_one(spark.read.schema(schema).parquet(f"{out}/*"), {k: F.col(k) for k in key}, order)
