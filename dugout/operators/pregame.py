"""Rows shown before a game starts: active roster, announced lineup, registered position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dugout.functions import rules
from dugout.model import (
    BATTER_COUNTERS, BATTER_FLAGS, PITCHER, PITCHER_COUNTERS, PITCHER_FLAGS, RELIEVER, STARTER,
)

BENCH_ORDER = 99


def pregame_games(games: DataFrame, now: Column) -> DataFrame:
    """Games not cancelled, not started, and inside the window before their start."""
    return games.filter(
        ~F.coalesce("cancel", F.lit(False))
        & F.col("status_code").isin("BEFORE", "READY")
        & rules.in_pregame_window(F.col("game_datetime"), now)
    )


def game_sides(games: DataFrame) -> DataFrame:
    """Two rows per game: side, own team and opponent."""
    def side(name: str, own: str, other: str) -> Column:
        return F.struct(
            F.lit(name).alias("side"), F.col(f"{own}_team_code").alias("team_code"),
            F.col(f"{own}_team_name").alias("team"), F.col(f"{other}_team_name").alias("opponent"),
        )

    sides = F.explode(F.array(side("home", "home", "away"), side("away", "away", "home"))).alias("s")
    return games.select("game_id", "game_date", sides).select("game_id", "game_date", "s.*")


def _zeros(counters, flags) -> list[Column]:
    return [(F.lit(False) if c in flags else F.lit(0)).alias(c) for c in counters]


def pregame_rows(
    games: DataFrame, roster: DataFrame, lineups: DataFrame, positions: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame]:
    """Zero-point batter and pitcher rows of everybody on the active roster."""
    named = (
        game_sides(pregame_games(games, now))
        .join(roster, ["team_code", "game_date"])
        .join(
            lineups.select(
                "game_id", "side", "name", "bat_order",
                F.coalesce("is_starting_pitcher", F.lit(False)).alias("starts"),
            ),
            ["game_id", "side", "name"], "left",
        )
    )
    arm = F.col("category") == PITCHER
    starts = F.coalesce("starts", F.lit(False))
    common = ["game_id", "game_date", "side", "name", "team", "opponent"]
    pitchers = named.filter(arm).select(
        *common, F.when(starts, STARTER).otherwise(RELIEVER).alias("role"), F.lit("").alias("inn"),
        starts.alias("is_starter"), F.lit("pregame").alias("status"), F.lit(0).alias("lp"),
        F.when(starts, 0).otherwise(1).alias("show_order"),
        *_zeros(PITCHER_COUNTERS, PITCHER_FLAGS),
    )
    known = positions.groupBy("name", "team").agg(
        F.max_by("effective_position", "player_code").alias("known_position")
    )
    batters = named.filter(~arm).join(known, ["name", "team"], "left").select(
        *common, F.coalesce("known_position", "category").alias("position"),
        F.lit(False).alias("position_override"), F.lit(0).alias("ab"),
        F.col("bat_order").isNotNull().alias("is_starter"), "bat_order",
        F.lit("pregame").alias("status"), F.lit(0).alias("lp"),
        F.coalesce("bat_order", F.lit(BENCH_ORDER)).alias("show_order"),
        *_zeros(BATTER_COUNTERS, BATTER_FLAGS),
    )
    return batters, pitchers
