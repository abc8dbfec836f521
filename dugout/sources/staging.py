"""Landed documents parsed once, as day-partitioned Parquet, with a manifest of what was parsed.

``<stage>/<league>/<kind>/game_date=<day>/batch=<batch>`` holds parsed documents (doc, key, result); a batch is one
run. ``<stage>/<league>/manifest/game_date=<day>`` holds a row for each landed file and run that parsed it: its
path, size and time. A run lists the landed files of its days, reads the JSON of those that the manifest does not
know with that size and time, appends them as a new batch and writes the manifest last. So a run that is lost
leaves the manifest as it was, and what it wrote is never read. A file that is landed again under its name takes the place of its earlier
documents; one that is gone takes them with it.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from dugout.session import COMPRESSED_FILES, OPEN_FILES, settings
from dugout.sources import landed

KINDS = {"schedule": landed.SCHEDULE, "record": landed.RECORD, "relay": landed.RELAY, "preview": landed.PREVIEW}
MANIFEST = "kind STRING, doc STRING, path STRING, length BIGINT, modified TIMESTAMP, gone BOOLEAN, batch STRING, game_date DATE"
_FILES = "doc STRING, path STRING, length BIGINT, modified TIMESTAMP, game_date DATE"


def stamp() -> str:
    """A name that sorts after all earlier ones and is no number to a partition reader."""
    return f"t{time.time_ns():020d}"


def day_folders(base: str, days: Sequence[str] | None) -> str:
    """The day folders of ``base``, so that the folders of other days are not even listed."""
    return base if days is None else f"{base}/game_date={{{','.join(sorted(days))}}}"


def read_days(spark: SparkSession, base: str, schema: str, days: Sequence[str] | None) -> DataFrame:
    """Parquet of the listed days under ``base``; what does not exist yet is empty."""
    try:
        return spark.read.schema(schema).option("basePath", base).parquet(day_folders(base, days))
    except AnalysisException:
        return spark.createDataFrame([], schema)


def landed_files(spark: SparkSession, base: str, days: Sequence[str] | None, packed: bool = False) -> DataFrame:
    """(doc, path, length, modified, game_date) of every landed file; no content is read. Packed files may be compressed."""
    names = "{*.json,*.json.gz}" if packed else "*.json"
    try:
        files = spark.read.format("binaryFile").option("basePath", base).option("pathGlobFilter", names).load(day_folders(base, days))
    except AnalysisException:
        return spark.createDataFrame([], _FILES)
    return files.select(
        F.col("_metadata.file_path").alias("doc"), "path", "length", F.col("modificationTime").alias("modified"), F.col("game_date").cast("date").alias("game_date"))


def manifest(spark: SparkSession, stage: str, league: str, days: Sequence[str] | None = None) -> DataFrame:
    """The latest row of each landed file of the days."""
    rows = read_days(spark, f"{stage}/{league}/manifest", MANIFEST, days)
    body = F.struct("path", "length", "modified", "gone", "batch", "game_date")
    return rows.groupBy("kind", "doc").agg(F.max_by(body, "batch").alias("b")).select("kind", "doc", "b.*")


def refresh(
    spark: SparkSession, root: str, stage: str, league: str, days: Sequence[str] | None = None, packed: bool = False
) -> dict[str, list[str]]:
    """Parse what is new, changed or gone since the last run; the days that changed, by kind.

    One JSON relation a kind at most. The names of changed files reach the driver, where Spark's own file index holds
    the names of all listed ones.
    """
    batch = stamp()
    known = manifest(spark, stage, league, days)
    entries, touched = None, {}
    for kind, schema in KINDS.items():
        base = f"{root}/{league}/{kind}"
        here = landed_files(spark, base, days, packed)
        before = known.where(F.col("kind") == kind).where("not gone")
        old = before.select("doc", F.col("length").alias("was_length"), F.col("modified").alias("was_modified"))
        fresh = here.join(old, "doc", "left").where("was_length is null or length <> was_length or modified <> was_modified").select(*here.columns)
        gone = before.join(here.select("doc"), "doc", "left_anti").select(*here.columns)
        changes = fresh.withColumn("gone", F.lit(False)).unionByName(gone.withColumn("gone", F.lit(True))).collect()
        if not changes:
            continue
        touched[kind] = sorted({str(r["game_date"]) for r in changes})
        paths = [r["path"] for r in changes if not r["gone"]]
        if paths:
            docs = landed.read_documents(spark, paths, schema, packed, base=base)
            docs = docs.withColumn("batch", F.lit(batch))
            # Packed files are large and of one day each: a task stores what it read, and no parsed document moves.
            # Others are rebalanced by day: a few large files a day, and more than one for a day that is too large for one task.
            compressed = any(path.endswith(".gz") for path in paths)
            with settings(spark, (OPEN_FILES if packed else {}) | (COMPRESSED_FILES if compressed else {})):
                docs = docs if packed else docs.hint("rebalance", "game_date")
                docs.write.mode("append").partitionBy("game_date", "batch").parquet(f"{stage}/{league}/{kind}")
        rows = [(kind, r["doc"], r["path"], r["length"], r["modified"], r["gone"], batch, r["game_date"]) for r in changes]
        entries = (entries or []) + rows
    if entries:
        spark.createDataFrame(entries, MANIFEST).repartition("game_date").write.mode("append").partitionBy("game_date").parquet(f"{stage}/{league}/manifest")
    return touched


def documents(spark: SparkSession, stage: str, league: str, kind: str, days: Sequence[str] | None = None) -> DataFrame:
    """(key, result, game_date) of the documents that are landed now; the day is that of the folder they landed in."""
    schema = f"doc STRING, key STRING, {KINDS[kind]}, batch STRING, game_date DATE"
    rows = read_days(spark, f"{stage}/{league}/{kind}", schema, days)
    now = manifest(spark, stage, league, days).where((F.col("kind") == kind) & ~F.col("gone")).select("doc", "batch")
    return rows.join(now, ["doc", "batch"], "left_semi").select("key", "result", "game_date")
