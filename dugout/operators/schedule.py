"""Calendar, to-do dates and the active window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dugout.functions import rules
from dugout.model import SEASON_ROUNDS

REFRESH_SECONDS = 3600


def build_calendar(games: DataFrame) -> DataFrame:
    """Per day: the round of its first game that is not cancelled, and how many such games.

    The games themselves stay rows, see :func:`calendar_games`; no day is collected into a list.
    """
    held = ~F.coalesce("cancel", F.lit(False))
    return games.groupBy("game_date").agg(
        F.min_by("round_code", F.when(held, F.struct("game_seq", "game_id"))).alias("round"),
        F.count_if(held).alias("games"),
    )


def calendar_games(games: DataFrame) -> DataFrame:
    """Games of the calendar, one row each."""
    return games.filter(~F.coalesce("cancel", F.lit(False))).select("game_date", "game_id", "game_seq")


def listed_games(calendar_file: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A calendar file (game_date, round, game_ids) as the two tables above."""
    days = calendar_file.select("game_date", "round", F.size("game_ids").cast("bigint").alias("games"))
    rows = calendar_file.select("game_date", F.posexplode("game_ids").alias("game_seq", "game_id"))
    return days, rows.select("game_date", "game_id", "game_seq")


def round_summary(calendar: DataFrame) -> DataFrame:
    return calendar.groupBy("round").agg(
        F.count(F.lit(1)).alias("days"), F.min("game_date").alias("first_day"),
        F.max("game_date").alias("last_day"),
    )


def season_days(calendar: DataFrame) -> DataFrame:
    """Days of official rounds with at least one game."""
    return calendar.filter(F.col("round").isin(*SEASON_ROUNDS) & (F.col("games") > 0))


def todo(targets: DataFrame, done: DataFrame, keys: list[str] = ["game_date"]) -> DataFrame:
    """Targets without the finished ones."""
    return targets.join(done.select(*keys).distinct(), keys, "left_anti")


def games_of_days(days: DataFrame, listed: DataFrame, games: DataFrame) -> DataFrame:
    """Games to process per day: those listed, else the schedule without cancelled games."""
    wanted = days.select("game_date").distinct()
    from_calendar = listed.join(wanted, "game_date", "left_semi").select("game_date", "game_id")
    unlisted = wanted.join(listed, "game_date", "left_anti")
    from_schedule = calendar_games(games).join(unlisted, "game_date", "left_semi")
    return from_calendar.unionByName(from_schedule.select("game_date", "game_id"))


def active_window(games: DataFrame, now: Column, hours: int = 2) -> DataFrame:
    """Per day: on from two hours before the first start until every game is over."""
    start = rules.korea_instant(F.col("game_datetime"))
    return games.groupBy("game_date").agg(
        F.min(start).alias("first_start"),
        F.max(F.coalesce(F.col("status_code") != "RESULT", F.lit(True))).alias("unfinished"),
    ).select(
        "game_date",
        F.coalesce(
            (now >= F.col("first_start") - F.expr(f"INTERVAL {int(hours)} HOURS")) & F.col("unfinished"),
            F.lit(False),
        ).alias("active"),
    )


def refresh_due(marker: DataFrame, now: Column, seconds: int = REFRESH_SECONDS) -> DataFrame:
    """One row: whether the last refresh is old enough, or there is none."""
    last = marker.agg(F.max("refreshed_at").alias("last"))
    return last.select(
        F.coalesce(F.unix_timestamp(now) - F.unix_timestamp("last") >= seconds, F.lit(True)).alias("due")
    )


def date_range(spark, first: str, last: str) -> DataFrame:
    return spark.range(1).select(
        F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("game_date")
    )
