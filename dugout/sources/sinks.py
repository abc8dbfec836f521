"""Partitioned marts, control tables and small exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

PARTITIONS = ("league", "game_date")


def write_days(rows: DataFrame, path: str, rows_per_file: int = 2_000_000) -> None:
    """Replace exactly the (league, day) partitions present in ``rows``, best scores first.

    Sorting by partition value before the write keeps one open file per task; range partitioning
    on the score as well lets one very large day spread over several tasks and files.
    """
    (
        rows.repartitionByRange(*PARTITIONS, F.desc("lp"), "game_id", "name")
        .sortWithinPartitions(*PARTITIONS, F.desc("lp"), "game_id", "name")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy(*PARTITIONS)
        .parquet(path)
    )


def date_index(batters: DataFrame) -> DataFrame:
    """Games per day, the light index of a calendar."""
    pairs = batters.groupBy("league", "game_date", "team", "opponent").agg(F.lit(1).alias("x"))
    return pairs.groupBy("league", "game_date").agg(
        F.floor(F.count(F.lit(1)) / 2).cast("bigint").alias("games")
    )


def write_control(rows: DataFrame, path: str) -> None:
    """Replace the (league, day) partitions present in ``rows``; a few rows a day, so one file each."""
    (
        rows.repartition(*PARTITIONS)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*PARTITIONS).parquet(path)
    )


def mark_done(days: DataFrame, path: str) -> None:
    """One mark for each finished day, however often it is scored."""
    write_control(days.select("league", "game_date").distinct().withColumn("done", F.lit(True)), path)


def read_done(spark: SparkSession, path: str) -> DataFrame:
    return _read_or_empty(spark, path, "done BOOLEAN, league STRING, game_date DATE").drop("done")


def mark_refreshed(spark: SparkSession, path: str, at: str) -> None:
    spark.sql("SELECT 1").select(F.to_timestamp(F.lit(at)).alias("refreshed_at")).write.mode(
        "append"
    ).parquet(path)


def read_refresh_marker(spark: SparkSession, path: str) -> DataFrame:
    return _read_or_empty(spark, path, "refreshed_at TIMESTAMP")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def _read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A control table that does not exist yet is empty."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
