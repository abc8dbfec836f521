"""Reference tables and roster pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dugout.functions.text import strip
from dugout.model import COST_LIST, ROSTER_CATEGORIES

# Page format of the active roster.
ROSTER_START, ROSTER_END = "선수등록명단", "등/말소 현황"
ROSTER_TABLE = r'(?s)<table class="tNData".*?</table>'
ROSTER_HEAD = r"(?s)<th[^>]*>(.*?)</th>\s*<th[^>]*>(.*?)</th>"
ROSTER_NAME = r'<a href="[^"]*playerId=\d+">([^<]+)</a>'


def read_cost_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw cost rows (hint, position, name, cost); a byte-order mark in the header is harmless."""
    return spark.read.schema(COST_LIST).option("header", True).option("enforceSchema", True).csv(path)


def read_positions_json(spark: SparkSession, path: str) -> DataFrame:
    """Position file ``{"players": {code: {..}}}`` to one row per player."""
    record = (
        "STRUCT<name: STRING, team: STRING, innings_by_position: MAP<STRING, DOUBLE>, games: BIGINT, "
        "auto_position: STRING, manual_position: STRING, effective_position: STRING>"
    )
    docs = spark.read.schema(f"players MAP<STRING, {record}>").option("multiLine", True).json(path)
    return docs.select(F.explode("players").alias("player_code", "p")).select("player_code", "p.*")


def read_calendar_json(spark: SparkSession, path: str) -> DataFrame:
    """Calendar file ``{date: {round, game_ids}}`` to one row per date."""
    text = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "MAP<STRING, STRUCT<round: STRING, game_ids: ARRAY<STRING>>>")
    return text.select(F.explode(parsed).alias("day", "info")).select(
        F.to_date("day").alias("game_date"), F.col("info.round").alias("round"),
        F.coalesce("info.game_ids", F.array().cast("array<string>")).alias("game_ids"),
    )


def roster_from_pages(pages: DataFrame) -> DataFrame:
    """(team_code, game_date, html) to active players by role; coaches are dropped.

    A name listed twice keeps its last role.
    """
    html = F.coalesce("html", F.lit(""))
    start = F.instr(html, F.lit(ROSTER_START))
    rest = F.when(start > 0, F.substring(html, start, F.length(html))).otherwise("")
    stop = F.instr(rest, F.lit(ROSTER_END))
    section = F.when(stop > 0, F.substring(rest, F.lit(1), stop - 1)).otherwise(
        # with no closing heading the slice ends one character early
        F.substring(rest, F.lit(1), F.greatest(F.length(rest) - 1, F.lit(0)))
    )
    tables = pages.select(
        "team_code", "game_date",
        F.posexplode(F.regexp_extract_all(section, F.lit(ROSTER_TABLE), F.lit(0))).alias("table_no", "t"),
    ).withColumn("category", strip(F.regexp_extract("t", ROSTER_HEAD, 2)))
    names = tables.filter(F.col("category").isin(*ROSTER_CATEGORIES)).select(
        "team_code", "game_date", "category", "table_no",
        F.posexplode(F.regexp_extract_all("t", F.lit(ROSTER_NAME), F.lit(1))).alias("name_no", "name"),
    )
    return names.groupBy("team_code", "game_date", "name").agg(
        F.max_by("category", F.struct("table_no", "name_no")).alias("category")
    )
