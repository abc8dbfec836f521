"""Registered position from recent fielding innings, with manual overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dugout.functions import innings, plate
from dugout.model import DH, UNKNOWN_POSITION

WINDOW_DAYS = 14


def fielding_rows(batters: DataFrame, team_pitching: DataFrame, games: DataFrame) -> DataFrame:
    """Batter lines of finished games with the innings of their side, the letters played and their place in the day."""
    over = games.filter(F.col("status_code") == "RESULT").select(
        "game_id", "game_date", "game_seq", "home_team_name", "away_team_name"
    )
    outs = team_pitching.select(
        "game_id", "side", (innings.outs_from_fraction(F.col("inn")) / 3).alias("def_innings")
    )
    home = F.col("side") == "home"
    return (
        batters.filter(F.coalesce("player_code", F.lit("")) != "")
        .join(over, "game_id")
        .join(outs, ["game_id", "side"], "left")
        .select(
            "game_date", "player_code", "name",
            F.when(home, F.col("home_team_name")).otherwise(F.col("away_team_name")).alias("team"),
            F.coalesce("def_innings", F.lit(0.0)).alias("def_innings"),
            plate.fielding_chars(F.col("pos")).alias("chars"),
            # schedule order, home before away, box order
            F.struct("game_seq", "game_id", F.when(home, 0).otherwise(1).alias("side_no"), "pos_idx").alias("place"),
        )
    )


def position_window(
    batters: DataFrame, team_pitching: DataFrame, games: DataFrame, end_date: str, days: int = WINDOW_DAYS
) -> DataFrame:
    """Fielding rows of the trailing window, placed with the newest day first.

    A game's innings are shared equally among the positions played in it. ``team`` is that of the oldest game
    in the window and ``name`` that of the newest.
    """
    end = F.to_date(F.lit(end_date))
    recent = games.filter(F.col("game_date").between(F.date_sub(end, days - 1), end))
    rows = fielding_rows(batters, team_pitching, recent)
    back = F.datediff(end, F.col("game_date")).alias("back")
    return rows.withColumn("place", F.struct(back, "place.*")).drop("game_date")


def _per_position(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, player and position; players without any fielding letter have one with a NULL position."""
    size = F.size("chars")
    spread = rows.select(
        *keys, "player_code", "name", "team", "place",
        F.posexplode_outer("chars").alias("char_no", "char"),
        F.when(size > 0, F.col("def_innings") / size).otherwise(F.lit(0.0)).alias("share"),
    ).withColumn("position", plate.position_of_char(F.col("char")))
    return spread.groupBy(*keys, "player_code", "position").agg(
        F.sum("share").alias("innings"),
        F.min(F.struct("place", "char_no")).alias("seen"),
        # Every game row is counted once: by its first letter, or by the row without letters.
        F.count_if(F.coalesce("char_no", F.lit(0)) == 0).alias("rows"),
        F.min_by("name", "place").alias("name"), F.min("place").alias("first_place"),
        F.max_by("team", "place").alias("team"), F.max("place").alias("last_place"),
    )


def _table(per_position: DataFrame, keys: list[str]) -> DataFrame:
    fielded = F.col("position").isNotNull()
    return per_position.groupBy(*keys, "player_code").agg(
        F.min_by("name", "first_place").alias("name"),
        F.max_by("team", "last_place").alias("team"),
        F.map_from_entries(
            F.array_sort(
                F.collect_list(
                    F.when(fielded, F.struct("position", F.bround("innings", 1).alias("innings")))
                )
            )
        ).alias("innings_by_position"),
        F.sum("rows").alias("games"),
        F.coalesce(F.sum(F.when(~fielded, F.col("rows"))), F.lit(0)).alias("dh_games"),
        F.min(
            F.when(fielded, F.struct((-F.round("innings", 9)).alias("less"), "seen", "position"))
        ).alias("best"),
    ).withColumn(
        "auto_position",
        F.coalesce(
            F.col("best.position"),
            F.when(F.col("dh_games") > 0, DH).otherwise(UNKNOWN_POSITION),
        ),
    ).drop("best")


def position_table(window_rows: DataFrame) -> DataFrame:
    """One row per player: innings by position, games, and the automatic position."""
    return _table(_per_position(window_rows, []), [])


def day_partials(rows: DataFrame) -> DataFrame:
    """What a day adds to any window that holds it: one row per (day, player, position)."""
    return _per_position(rows, ["game_date"])


def reached(games: DataFrame, ends: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """Games of the days that a window up to some ``end_date`` of ``ends`` holds; no other day adds to a window.

    The days are those of a calendar, so they go to the games.
    """
    near = F.explode(F.sequence(F.date_sub("end_date", days - 1), "end_date")).alias("game_date")
    return games.join(F.broadcast(ends.select(near).distinct()), "game_date", "left_semi")


def rolling_table(partials: DataFrame, ends: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """:func:`position_table` for the ``days`` up to each ``end_date`` of ``ends``, from day partials alone.

    A day reaches ``days`` windows, so a partial is at most as many rows here, however many boxes it stands for. The ends
    are days of a calendar and go to the partials; a merge would move every partial ``days`` times.
    """
    reach = F.explode(F.sequence("game_date", F.date_add("game_date", days - 1))).alias("end_date")
    near = partials.select("*", reach).join(F.broadcast(ends.select("end_date").distinct()), "end_date")
    back = F.datediff("end_date", "game_date").alias("back")

    def placed(name: str):
        return F.struct(back, F.col(name).alias("p"))

    per_position = near.groupBy("end_date", "player_code", "position").agg(
        F.sum("innings").alias("innings"), F.min(placed("seen")).alias("seen"), F.sum("rows").alias("rows"),
        F.min_by("name", placed("first_place")).alias("name"), F.min(placed("first_place")).alias("first_place"),
        F.max_by("team", placed("last_place")).alias("team"), F.max(placed("last_place")).alias("last_place"),
    )
    return _table(per_position, ["end_date"])


def merge_overrides(table: DataFrame, previous: DataFrame) -> DataFrame:
    """Keep manual positions over a recompute; players out of the window stay only with one."""
    old = previous.select(
        "player_code", *[F.col(c).alias(f"__{c}") for c in previous.columns if c != "player_code"]
    )
    manual = F.nullif(F.col("__manual_position"), F.lit(""))
    joined = table.withColumn("__in_window", F.lit(True)).join(old, "player_code", "full")
    inside = F.coalesce("__in_window", F.lit(False))
    carried = ("name", "team", "innings_by_position", "games", "auto_position")
    return (
        joined.filter(inside | manual.isNotNull())
        .select(
            "player_code",
            *[
                F.when(inside, F.col(c)).otherwise(F.col(f"__{c}")).alias(c)
                for c in carried if c in table.columns and c in previous.columns
            ],
            F.col("__manual_position").alias("manual_position"),
        )
        .withColumn(
            "effective_position",
            F.coalesce(F.nullif(F.col("manual_position"), F.lit("")), F.col("auto_position")),
        )
    )


def apply_overrides(table: DataFrame, requests: DataFrame) -> DataFrame:
    """Set (or, with a blank position, clear) manual positions of known players.

    ``requests`` is (player_code, new_position), one row per player.
    """
    asked = requests.select("player_code", "new_position", F.lit(True).alias("__asked"))
    manual = F.when(F.col("__asked"), F.nullif(F.col("new_position"), F.lit(""))).otherwise(
        F.col("manual_position")
    )
    return (
        table.join(asked, "player_code", "left")
        .withColumn("manual_position", manual)
        .withColumn("effective_position", F.coalesce("manual_position", "auto_position"))
        .select(*table.columns)
    )


def rejected_overrides(table: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests for players nobody knows."""
    return requests.join(table.select("player_code"), "player_code", "left_anti")


def attach_position(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Registered position and whether it was set by hand."""
    known = table.select(
        "player_code", F.col("effective_position").alias("position"),
        F.coalesce(F.col("manual_position") != "", F.lit(False)).alias("position_override"),
    )
    return rows.join(known, "player_code", "left").withColumns(
        {
            "position": F.coalesce("position", F.lit("")),
            "position_override": F.coalesce("position_override", F.lit(False)),
        }
    )


def find_by_name(table: DataFrame, text: str) -> DataFrame:
    return table.filter(F.col("name").contains(text))
