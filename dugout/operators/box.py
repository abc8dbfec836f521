"""Box score to counters: who appeared, what they did, special records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dugout.functions import innings, plate, records, scoring
from dugout.functions.text import is_blank
from dugout.model import (
    BATTER_COUNTERS, LEAGUE_RULES, PITCHER_COUNTERS, PITCHER_FLAGS, RELIEVER, STARTER,
)


def batter_appeared() -> Column:
    numbers = ("ab", "hit", "bb", "run", "rbi", "hr", "sb", "kk")
    any_number = F.lit(False)
    for name in numbers:
        any_number = any_number | (F.coalesce(F.col(name), F.lit(0)) != 0)
    return any_number | F.coalesce("substitute_in", F.lit(False)) | ~is_blank(F.col("pos"))


def pitcher_appeared(outs: Column) -> Column:
    """Cheap tests come first: the innings text is parsed only where nothing else decides."""
    any_number = F.lit(False)
    for name in ("hit", "er", "hr", "bb", "bbhp", "kk"):
        any_number = any_number | (F.coalesce(F.col(name), F.lit(0)) != 0)
    return any_number | ~is_blank(F.col("wls")) | (outs != 0)


def class_counts(rows: DataFrame, keys: list[str], code: str = "code") -> DataFrame:
    """Counts per class over one-code-per-row data; partial sums run before the shuffle."""
    parts = rows.select(*keys, F.explode(plate.plate_codes(F.array(code))).alias("code"))
    classed = parts.withColumn("class", plate.plate_class(F.col("code")))
    return classed.groupBy(*keys).agg(
        *[F.count_if(F.col("class") == c).cast("int").alias(f"pa_{c}") for c in plate.PLATE_CLASSES]
    )


def with_class_counts(batters: DataFrame) -> DataFrame:
    """Counts per class of the row's own codes; no shuffle."""
    classed = batters.withColumn("__classes", plate.plate_classes(F.col("pa_codes")))
    return classed.withColumns(
        {f"pa_{c}": plate.class_count(F.col("__classes"), c) for c in plate.PLATE_CLASSES}
    ).drop("__classes")


def special_mentions(etc_records: DataFrame) -> DataFrame:
    """One row per name mentioned: (game_id, name, counter, inn)."""
    text = F.coalesce("result", F.lit(""))
    kind = None
    for word, counter in records.RECORD_KINDS.items():
        kind = F.when(F.col("how") == word, counter) if kind is None else kind.when(F.col("how") == word, counter)
    slam = F.transform(
        records.grand_slam_names(text),
        lambda n: F.struct(n.alias("name"), F.lit(None).cast("int").alias("inn")),
    )
    return (
        etc_records.withColumn("counter", kind)
        .filter(F.col("counter").isNotNull())
        .select(
            "game_id", "idx",
            F.when(F.col("counter") == "HR", "GRANDSLAM").otherwise(F.col("counter")).alias("counter"),
            F.posexplode(
                F.when(F.col("counter") == "HR", slam).otherwise(records.name_innings(text))
            ).alias("item", "m"),
        )
        .select("game_id", "counter", "idx", "item", "m.name", "m.inn")
    )


def special_counts(etc_records: DataFrame) -> DataFrame:
    """Per (game, name) counts of errors, wild pitches, caught stealing, balks and pickoffs."""
    mentions = special_mentions(etc_records)
    kind = F.col("counter")
    return mentions.groupBy("game_id", "name").agg(
        *[
            F.count_if(kind == c).cast("int").alias(f"rec_{c}")
            for c in ("E", "WP", "CS", "BK", "PICKOFF")
        ],
        F.max((kind == "GRANDSLAM").cast("int")).alias("rec_GRANDSLAM"),
    )


def grand_slam_changes(etc_records: DataFrame) -> DataFrame:
    """Home-run records the earlier and the present reading disagree on."""
    text = F.trim(F.coalesce("result", F.lit("")))
    return (
        etc_records.filter(F.col("how") == "홈런")
        .select(
            "game_id", "idx",
            records.grand_slam_names_single(text).alias("old_names"),
            records.grand_slam_names(text).alias("new_names"),
        )
        .filter(F.col("old_names") != F.col("new_names"))
    )


def _recorded(name: str) -> Column:
    return F.coalesce(F.col(f"rec_{name}"), F.lit(0))


def batter_counters(
    batters: DataFrame, specials: DataFrame | None, counted: bool = False
) -> DataFrame:
    """First-league batter rows with all counters. ``counted`` says pa_* columns exist already."""
    rows = batters.filter(batter_appeared())
    if not counted:
        rows = with_class_counts(rows)
    rows = _attach_specials(rows, specials)
    zero = F.lit(0)
    box = {
        "R": "run", "H": "hit", "BB": "bb", "HR": "hr", "RBI": "rbi", "SB": "sb", "K": "kk",
    }
    values: dict[str, Column] = {k: F.coalesce(F.col(v), zero) for k, v in box.items()}
    for name in ("2B", "3B", "LD", "GDP", "SACFLY", "SACBUNT", "HBP"):
        values[name] = F.col(f"pa_{name}")
    values["FO"] = F.col("pa_FO") + F.col("pa_SACFLY")
    values["GO"] = F.col("pa_GO") + F.col("pa_SACBUNT") + F.col("pa_GDP")
    values["CYCLE"] = (
        (F.col("pa_1B") > 0) & (F.col("pa_2B") > 0) & (F.col("pa_3B") > 0)
        & (F.coalesce("hr", zero) != 0)
    )
    for name in ("CS", "PICKOFF", "E", "GRANDSLAM"):
        values[name] = _recorded(name)
    identity = [c for c in batters.columns if c not in {*box.values(), "hbp", "pa_codes"} and not c.startswith("pa_")]
    return rows.select(
        *identity,
        *[values.get(c, F.lit(0)).alias(c) for c in BATTER_COUNTERS],
    )


def _attach_specials(rows: DataFrame, specials: DataFrame | None) -> DataFrame:
    """Special records go by name within the game; teams are not told apart."""
    if specials is None:
        return rows.withColumns(
            {f"rec_{c}": F.lit(0) for c in ("E", "WP", "CS", "BK", "PICKOFF", "GRANDSLAM")}
        )
    return rows.join(specials, ["game_id", "name"], "left")


def pitcher_counters(
    pitchers: DataFrame,
    team_outs: DataFrame,
    status: DataFrame,
    specials: DataFrame | None,
    league: str = "kbo",
) -> DataFrame:
    """Pitcher rows with all counters.

    ``team_outs`` is (game_id, side, team_outs); ``status`` is (game_id, status_code), where an
    unknown status means the game is not over.
    """
    zero = F.lit(0)
    outs = innings.outs(F.col("inn"), league)
    rows = pitchers.withColumn("OUT", outs)
    if league == "kbo":
        rows = rows.filter(pitcher_appeared(F.col("OUT")))
    # Joined by the game alone, as the joins before and after it: rows are moved once. The two bounds say that the sides are equal.
    outs_of = team_outs.select(F.col("game_id").alias("of_game"), F.col("side").alias("of_side"), "team_outs")
    same_game = (F.col("game_id") == F.col("of_game")) & (F.col("side") >= F.col("of_side")) & (F.col("side") <= F.col("of_side"))
    rows = (
        _attach_specials(rows, specials)
        .join(outs_of, same_game, "left").drop("of_game", "of_side")
        .join(status.select("game_id", "status_code"), "game_id", "left")
    )
    box = {n: F.coalesce(F.col(n), zero) for n in ("hit", "r", "er", "hr", "bb", "bbhp", "kk")}
    starter = F.col("pos_idx") == 0
    free = box["bbhp"] if LEAGUE_RULES[league]["perfect_counts_hbp"] else box["bb"]
    values: dict[str, Column] = {
        "H": box["hit"], "HR": box["hr"], "ER": box["er"], "BB": box["bb"], "K": box["kk"],
        "HBP": scoring.hit_by_pitch(box["bbhp"], box["bb"]) if league == "kbo" else zero,
        "OUT": F.col("OUT"),
        "WP": _recorded("WP"), "BK": _recorded("BK"),
    }
    values |= scoring.start_flags(
        F.col("OUT"), box["er"], box["r"], box["hit"], free, starter,
        F.coalesce(F.col("status_code") == "RESULT", F.lit(False)), F.col("team_outs"), league,
    )
    values |= scoring.decision_flags(F.col("wls"))
    return rows.select(
        *[c for c in pitchers.columns if c in ("game_id", "side", "pos_idx", "name", "inn")],
        F.when(starter, STARTER).otherwise(RELIEVER).alias("role"),
        *[values.get(c, F.lit(False) if c in PITCHER_FLAGS else zero).alias(c) for c in PITCHER_COUNTERS],
    )


def team_outs_from_box(team_pitching: DataFrame) -> DataFrame:
    """First league: the box states the team's innings."""
    return team_pitching.select(
        "game_id", "side", innings.outs_from_fraction(F.col("inn")).alias("team_outs")
    )


def team_outs_from_pitchers(pitchers: DataFrame) -> DataFrame:
    """Second league: the team's outs are the sum over its pitchers."""
    return pitchers.groupBy("game_id", "side").agg(
        F.sum(innings.outs_from_decimal(F.col("inn"))).cast("int").alias("team_outs")
    )


def attach_game(rows: DataFrame, games: DataFrame) -> DataFrame:
    """Team, opponent, date and stadium from the game's own row."""
    home = F.col("side") == "home"
    info = games.select(
        "game_id", "league", "game_date", "home_team_name", "away_team_name",
        *([c for c in ("stadium",) if c in games.columns]),
    )
    out = rows.join(info, "game_id").withColumns(
        {
            "team": F.when(home, F.col("home_team_name")).otherwise(F.col("away_team_name")),
            "opponent": F.when(home, F.col("away_team_name")).otherwise(F.col("home_team_name")),
        }
    )
    if "stadium" not in games.columns:
        out = out.withColumn("stadium", F.lit(""))
    return out.drop("home_team_name", "away_team_name")


def live_games(games: DataFrame) -> DataFrame:
    """Games past the pregame states."""
    return games.filter(~F.coalesce("status_code", F.lit("")).isin("BEFORE", "READY"))


def not_cancelled(games: DataFrame) -> DataFrame:
    return games.filter(~F.coalesce("cancel", F.lit(False)))


def finished(games: DataFrame) -> DataFrame:
    return games.filter(F.col("status_code") == "RESULT")
