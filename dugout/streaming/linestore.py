"""Lines of live days in versions: late, repeated and corrected ones are appended, and the latest is read.

``<store>/lines/game_date=<day>/bucket=<bucket>/batch=<batch>`` holds lines as they came. A micro-batch writes one delta
for each (day, bucket) it touches, under its own id, so a batch that is played again replaces what it wrote before. A
compaction writes the latest line of each key of a day as one batch and then adds a row to ``<store>/compacted``, which
says up to which delta it reaches; a compaction that is lost before that row is never read. Readers list the folders
of their days alone and open, for each day, the last compaction and the deltas after it. A line's versions are always in one bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from dugout.model import RELAY_EVENTS
from dugout.sources.staging import day_folders

BUCKETS = 16
#: Deltas of a day after which a micro-batch compacts it.
COMPACT_AFTER = 20
KEY = ("game_id", "no", "sub")
LINES = RELAY_EVENTS + ", ingested_at TIMESTAMP"
_STORED = LINES + ", game_date DATE, bucket INT, batch STRING"
_MARKS = "game_date DATE, upto STRING"


def _delta(batch_id: int) -> str:
    return f"d{batch_id:012d}"


def _merged(upto: str) -> str:
    return f"m{upto[1:]}"


def _write(rows: DataFrame, store: str, batch: Column) -> None:
    """Replace the (day, bucket, batch) folders of the rows; a large bucket of a day may be several files."""
    rows = rows.withColumn("bucket", F.expr(f"cast(pmod(xxhash64(game_id), {BUCKETS}) as int)")).withColumn("batch", batch)
    keys = ("game_date", "bucket", "batch")
    rows.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{store}/lines")


def append(lines: DataFrame, store: str, batch_id: int) -> None:
    """One micro-batch of lines; those without a day belong to none and stay out."""
    _write(lines.where("game_date is not null"), store, F.lit(_delta(batch_id)))


def _marks(spark: SparkSession, store: str, days: Sequence[str]) -> dict[str, str]:
    """Last compaction of each of the days; one row a day."""
    try:
        rows = spark.read.schema(_MARKS).parquet(f"{store}/compacted")
    except AnalysisException:
        return {}
    wanted = rows.where(F.col("game_date").isin([F.to_date(F.lit(d)) for d in days]))
    return {str(r["game_date"]): r["upto"] for r in wanted.groupBy("game_date").agg(F.max("upto").alias("upto")).collect()}


def _stored(spark: SparkSession, store: str, days: Sequence[str]) -> DataFrame:
    """The folders of the days that count now: the last compaction and the deltas after it."""
    base = f"{store}/lines"
    try:
        rows = spark.read.schema(_STORED).option("basePath", base).parquet(day_folders(base, days))
    except AnalysisException:
        return spark.createDataFrame([], _STORED)
    marks = _marks(spark, store, days)
    counts = F.col("batch").startswith("d")
    for day, upto in marks.items():
        here = F.col("game_date") == F.to_date(F.lit(day))
        counts = F.when(here, (F.col("batch") == _merged(upto)) | ((F.col("batch") > upto) & F.col("batch").startswith("d"))).otherwise(counts)
    return rows.where(counts)


def latest(rows: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """One row per (game, no, sub): the one ingested last, ties to the greater text. Aggregated map-side, no window."""
    keys = (*within, *KEY)
    body = F.struct(*[c for c in rows.columns if c not in keys])
    newest = F.max_by(body, F.struct("ingested_at", "text")).alias("b")
    return rows.groupBy(*keys).agg(newest).select(*keys, "b.*")


def lines(spark: SparkSession, store: str, days: Sequence[str]) -> DataFrame:
    """All lines of the days so far, the latest version of each."""
    return latest(_stored(spark, store, days), ("game_date", "bucket")).drop("bucket", "batch")


def compact(spark: SparkSession, store: str, days: Sequence[str]) -> None:
    """Write the latest lines of each day as one batch that stands for all its deltas."""
    found = _stored(spark, store, days)
    ends = found.where(F.col("batch").startswith("d")).groupBy("game_date").agg(F.max("batch").alias("upto"))
    upto = [(str(r["game_date"]), r["upto"]) for r in ends.collect()]
    if not upto:
        return
    marks = spark.createDataFrame(upto, "game_date STRING, upto STRING").withColumn("game_date", F.to_date("game_date"))
    kept = latest(found, ("game_date", "bucket")).join(marks, "game_date")
    kept = kept.withColumn("batch", F.concat(F.lit("m"), F.substring("upto", 2, 99))).drop("upto")
    _write(kept, store, F.col("batch"))
    marks.coalesce(1).write.mode("append").parquet(f"{store}/compacted")


def follow(
    stream: DataFrame, store: str, recompute: Callable[[SparkSession, list[str], DataFrame], None], checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Keep each micro-batch and call ``recompute`` with the days it touched and all their lines. One row a day reaches the driver.

    One stream feeds a store: its batch ids name the deltas.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        days = sorted(str(r["game_date"]) for r in batch.select("game_date").where("game_date is not null").distinct().collect())
        if not days:
            return
        append(batch, store, batch_id)
        recompute(spark, days, lines(spark, store, days))
        deltas = _stored(spark, store, days).where(F.col("batch").startswith("d")).groupBy("game_date").agg(F.count_distinct("batch").alias("n"))
        many = [str(r["game_date"]) for r in deltas.where(F.col("n") >= COMPACT_AFTER).collect()]
        if many:
            compact(spark, store, many)

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
