"""Day marts in versions: a run writes its days beside the earlier ones and then moves a pointer.

``<mart>/<table>/version=<version>/league=<league>/game_date=<day>`` holds rows; ``<mart>/published`` holds one row for each
(league, day) and run: the version, and whether every game of the day was over. A reader takes the last version of
each day. The pointer table grows by one small file a run, written last and whole, so a run that is lost before
leaves every day as it was, and one that is done has moved all its tables at once. A day that lost its rows points to a
version without rows; the columns of each version are kept in ``<mart>/columns/<table>``. Nothing is deleted here: ``superseded`` lists what no pointer names any more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from dugout.sources.staging import stamp

POINTERS = "league STRING, game_date DATE, version STRING, final BOOLEAN"
KEYS = ("league", "game_date")


def new_version() -> str:
    return stamp()


def write(rows: DataFrame, mart: str, table: str, version: str, order: Sequence[str] = (), rows_per_file: int = 2_000_000) -> None:
    """``rows`` of whole days as a version of ``table``; a second call for the version replaces the first.

    ``order``: columns that rows stand in inside a day, ``-`` before those that descend. A range over day and order lets
    a very large day spread over several tasks and files.
    """
    columns = [F.desc(c[1:]) if c.startswith("-") else F.col(c) for c in order]
    if columns:
        rows = rows.repartitionByRange(*KEYS, *columns).sortWithinPartitions(*KEYS, *columns)
    else:
        rows = rows.hint("rebalance", *KEYS)
    whole = rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
    whole.option("maxRecordsPerFile", rows_per_file).partitionBy(*KEYS).parquet(f"{mart}/{table}/version={version}")
    empty = rows.sparkSession.createDataFrame([], rows.schema).coalesce(1)
    empty.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{mart}/columns/{table}/version={version}")


def publish(days: DataFrame, mart: str, version: str) -> None:
    """Point the days (league, game_date, final) to ``version``. One row a day, one file."""
    rows = days.select("league", F.col("game_date").cast("date").alias("game_date"), F.lit(version).alias("version"), F.coalesce("final", F.lit(False)).alias("final"))
    rows.coalesce(1).write.mode("append").parquet(f"{mart}/published")


def pointers(spark: SparkSession, mart: str) -> DataFrame:
    """The last (version, final) of every (league, day)."""
    try:
        rows = spark.read.schema(POINTERS).parquet(f"{mart}/published")
    except AnalysisException:
        rows = spark.createDataFrame([], POINTERS)
    last = F.max_by(F.struct("version", "final"), F.struct("version", "final")).alias("p")
    return rows.groupBy(*KEYS).agg(last).select(*KEYS, "p.*")


def done(spark: SparkSession, mart: str, league: str) -> DataFrame:
    """Days that were published with every game over."""
    return pointers(spark, mart).where((F.col("league") == league) & F.col("final")).select(*KEYS)


def read(spark: SparkSession, mart: str, table: str, league: str | None = None, days: Sequence[str] | None = None) -> DataFrame:
    """The published rows of a table. Only folders of versions that are pointed to are listed, at most one a day."""
    now = pointers(spark, mart)
    if league is not None:
        now = now.where(F.col("league") == league)
    if days is not None:
        now = now.where(F.col("game_date").isin([F.to_date(F.lit(d)) for d in days]))
    versions = sorted(r["version"] for r in now.select("version").distinct().collect())
    at = f"version={{{','.join(versions)}}}"
    try:
        columns = spark.read.option("mergeSchema", True).option("basePath", f"{mart}/columns/{table}").parquet(f"{mart}/columns/{table}/{at}").schema
    except AnalysisException:  # no version has the table
        return spark.createDataFrame([], "league STRING, game_date DATE")
    try:
        found = spark.read.schema(columns).option("basePath", f"{mart}/{table}").parquet(f"{mart}/{table}/{at}")
    except AnalysisException:
        return spark.createDataFrame([], columns).drop("version")
    if days is not None:
        found = found.where(F.col("game_date").isin([F.to_date(F.lit(d)) for d in days]))
    return found.join(now.select(*KEYS, "version"), [*KEYS, "version"], "left_semi").drop("version")


def superseded(spark: SparkSession, mart: str) -> DataFrame:
    """(league, game_date, version) that were published once and are not any more."""
    every = spark.read.schema(POINTERS).parquet(f"{mart}/published").select(*KEYS, "version").distinct()
    return every.join(pointers(spark, mart), [*KEYS, "version"], "left_anti")
