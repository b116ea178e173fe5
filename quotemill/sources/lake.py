"""A two-zone Parquet lake of raw records and clean quotes: partitioned, idempotent to write, deduplicated to read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.operators.dedup import keep_one
from quotemill.operators.latest import keep_last
from quotemill.session import Stored

#: Folders. Snapshots may be as many as seconds, so they are a column and share their day's files.
PARTS = ["source", "date"]
SNAPSHOT = [*PARTS, "snapshot"]
RAW_KEY = ["source", "market_id", "snapshot_ts"]
QUOTE_KEY = ["source", "market_id", "outcome", "snapshot_ts"]
#: Instants outside are mistakes and read as null.
SPAN = ("1678-01-01", "2261-12-31")


def _stamped(df: DataFrame) -> DataFrame:
    return df.withColumns({"date": F.date_format("snapshot_ts", "yyyy-MM-dd"), "snapshot": F.date_format("snapshot_ts", "yyyyMMdd'T'HHmmss'Z'")})


def _same(rows: DataFrame, others: DataFrame, cols: list[str], how: str) -> DataFrame:
    """The rows that others hold (left_semi) or don't hold (left_anti) by these columns; nulls are equal."""
    theirs = others.select(*[F.col(c).alias(f"_{c}") for c in cols]).distinct()
    on = F.lit(True)
    for c in cols:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(theirs, on, how)


def _write(df: DataFrame, path: str, key: list[str], by: list[str]) -> None:
    one = keep_one(_stamped(df), {k: F.col(k) for k in key}, by)
    old = _read(df.sparkSession, path)
    if old is not None:
        # Other snapshots of the days that are replaced stay; what is replaced is read first, so it goes by way of the shared folder.
        new = Stored(one).df
        kept = _same(_same(old, new, PARTS, "left_semi"), new, SNAPSHOT, "left_anti")
        one = Stored(kept.unionByName(new, allowMissingColumns=True)).df
    # One writer a partition and hash of the key's rest, so that a hot source doesn't hang on one task.
    one.repartition(*PARTS, F.pmod(F.xxhash64("market_id"), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).parquet(path)


def write_raw(records: DataFrame, root: str) -> None:
    """Raw records into their days' partitions; written again, a snapshot is replaced, others of its day stay. Of copies the smallest payload is kept."""
    _write(records, f"{root}/raw", RAW_KEY, ["payload"])


def write_quotes(rows: DataFrame, root: str) -> None:
    """Quotes likewise, of any number of sources and snapshots at once."""
    _write(rows, f"{root}/clean", QUOTE_KEY, ["price"])


def _merged(rows: DataFrame, path: str, key: list[str], order: str) -> DataFrame:
    """rows together with what is there of the snapshots they touch, one copy of each key, the new one winning."""
    old = _read(rows.sparkSession, path)
    if old is None:
        return rows
    kept = _same(old, _stamped(rows), SNAPSHOT, "left_semi").drop("date", "snapshot")
    # What is replaced is read first, so it goes by way of the shared folder.
    return Stored(keep_last([kept, rows], key, [F.col(order).asc_nulls_last()])).df


def merge_quotes(rows: DataFrame, root: str) -> None:
    """Adds quotes to the snapshots they belong to without losing what is there: touched snapshots are read, joined with the new rows and replaced."""
    write_quotes(_merged(rows, f"{root}/clean", QUOTE_KEY, "price"), root)


def merge_raw(records: DataFrame, root: str) -> None:
    """Raw records likewise."""
    write_raw(_merged(records, f"{root}/raw", RAW_KEY, "payload"), root)


def exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    if not exists(spark, path):
        return None
    try:
        found = spark.read.option("mergeSchema", "true").parquet(path).schema
    except AnalysisException as e:
        if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":  # a zone that only empty batches were written to
            return None
        raise
    # Partition values stay text, whatever they look like.
    texts = T.StructType([T.StructField(f.name, T.StringType() if f.name in PARTS else f.dataType) for f in found.fields])
    return spark.read.schema(texts).parquet(path)


def read_quotes(spark: SparkSession, root: str, source: str | None = None) -> DataFrame | None:
    """The clean zone, one copy of each quote, of one source (only its partitions are read) or all; None if nothing was ever written."""
    rows = _read(spark, f"{root}/clean")
    if rows is None:
        return None
    if source is not None:
        rows = rows.filter(F.col("source") == source)
    for c, kind in rows.dtypes:
        if kind == "timestamp":
            rows = rows.withColumn(c, F.when(F.col(c).between(F.lit(SPAN[0]).cast("timestamp"), F.lit(SPAN[1]).cast("timestamp")), F.col(c)))
    return keep_one(rows.drop("date", "snapshot"), {k: F.col(k) for k in QUOTE_KEY}, ["price"])


def read_raw(spark: SparkSession, root: str) -> DataFrame | None:
    """The raw zone as it lies, copies included."""
    rows = _read(spark, f"{root}/raw")
    return None if rows is None else rows.drop("date", "snapshot")


def sources(spark: SparkSession, root: str) -> list[str]:
    """The sources that either zone has partitions of."""
    found = [z.select("source").distinct() for z in (_read(spark, f"{root}/{zone}") for zone in ("raw", "clean")) if z is not None]
    if not found:
        return []
    union = found[0] if len(found) == 1 else found[0].union(found[1]).distinct()
    return sorted(r["source"] for r in union.collect())  # partition names only


def resolutions(spark: SparkSession, *paths: str) -> DataFrame:
    """Outcomes from CSV files (market_id, outcome), a later file's winning over an earlier one's."""
    parts = [spark.read.csv(_current(spark, p) or p, header=True, schema="market_id string, outcome int, note string").select("market_id", "outcome").filter("market_id is not null and outcome is not null") for p in paths]
    return keep_last(parts, ["market_id"], [F.desc("outcome")])


def upsert_outcomes(spark: SparkSession, new: DataFrame, path: str) -> None:
    """Outcomes (market_id, outcome) put into a folder of CSV files: a new one wins over what is there. Each time is a version of its own, so a reader meets the last whole one."""
    parts = [new.select("market_id", F.col("outcome").cast("int").alias("outcome")).filter("market_id is not null and outcome is not null")]
    if exists(spark, path):
        parts.insert(0, resolutions(spark, path))
    rows = keep_last(parts, ["market_id"], [F.desc("outcome")]).withColumn("note", F.lit(""))
    _next(spark, path, lambda version: rows.coalesce(1).write.csv(version, header=True))


def write_state(spark: SparkSession, path: str, **values: float | int | str) -> None:
    """A handful of named values as one row of JSON, a version of its own."""
    row = spark.createDataFrame([tuple(values.values())], list(values))
    _next(spark, path, lambda version: row.coalesce(1).write.json(version))


def read_state(spark: SparkSession, path: str, name: str, default: float) -> float:
    """A named value of a state, or the default where there is none yet."""
    if not exists(spark, path):
        return default
    row = spark.read.schema(f"{name} double").json(_current(spark, path) or path).first()
    return default if row is None or row[name] is None else row[name]


def _versions(spark: SparkSession, path: str) -> list[str]:
    """The whole versions below a path, the oldest first."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at(path)) or not files.getFileStatus(at(path)).isDirectory():
        return []
    names = sorted(s.getPath().getName() for s in files.listStatus(at(path)))
    return [f"{path}/{n}" for n in names if n.startswith("version-") and files.exists(at(f"{path}/{n}/_SUCCESS"))]


def _current(spark: SparkSession, path: str) -> str | None:
    found = _versions(spark, path)
    return found[-1] if found else None


def _next(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Writes the next version; it counts once it is whole. The one before stays for readers that have begun, older ones go."""
    found = _versions(spark, path)
    number = int(found[-1].rpartition("-")[2]) + 1 if found else 1
    at = spark._jvm.org.apache.hadoop.fs.Path
    files, fresh = at(path).getFileSystem(spark._jsc.hadoopConfiguration()), f"{path}/version-{number:012d}"
    files.delete(at(fresh), True)  # half written by one that failed
    write(fresh)
    for old in found[:-1]:
        files.delete(at(old), True)


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """Manual decisions from CSV: a and b ('source:market_id'), relation; blank cells as empty text."""
    cols = ["source_a", "market_id_a", "source_b", "market_id_b", "relation"]
    rows = spark.read.csv(path, header=True, schema=", ".join(f"{c} string" for c in cols)).fillna("")
    clean = rows.select(*[F.trim(c).alias(c) for c in cols])
    return clean.select(F.concat_ws(":", F.lower("source_a"), "market_id_a").alias("a"), F.concat_ws(":", F.lower("source_b"), "market_id_b").alias("b"), F.lower("relation").alias("relation"))
