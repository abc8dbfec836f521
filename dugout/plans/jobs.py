"""Batch jobs: score days, backfill, reprocess, refresh positions, build the calendar.

A landing folder holds ``schedule``, ``record``, ``relay`` and ``preview``, each with
``game_date=YYYY-MM-DD`` folders, so a job reads only the days it works on. Documents are parsed once, into the
``staged`` folder of the mart (``sources/staging.py``). The tables of ``MARTS`` are written in versions by league and day and
published together (``sources/published.py``); ``position_refresh`` marks when positions were made.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dugout.model import POSITIONS
from dugout.operators import box, cost, merge, positions as pos, pregame, relay, schedule, second_league as sl
from dugout.session import cut
from dugout.sources import landed, published, sinks, staging


#: Tables of a mart folder that hold the rows of a day.
MARTS = ("batters", "pitchers", "ledger", "position_events", "quarantine", "gaps", "position_days")
#: Days that backfill and reprocess score and mark at a time.
BATCH = 14


@dataclass
class Landing:
    """Inputs of one league, read lazily."""

    games: DataFrame
    batters: DataFrame
    pitchers: DataFrame
    relay: DataFrame
    gaps: DataFrame
    lineups: DataFrame
    stadiums: DataFrame
    folder_days: DataFrame | None = None
    team_pitching: DataFrame | None = None
    etc_records: DataFrame | None = None
    info: DataFrame | None = None


@dataclass
class ScoredDays:
    batters: DataFrame
    pitchers: DataFrame
    ledger: DataFrame | None
    position_events: DataFrame | None
    quarantine: DataFrame


def _landing(docs: Callable[[str], DataFrame], league: str) -> Landing:
    """``docs``: the documents of a kind."""
    kept = docs("record")
    records, lines = landed.records_of(kept), docs("relay")
    days = kept.select(F.col("key").alias("game_id"), "game_date") if "game_date" in kept.columns else None
    rows = (landed.batters(records, league), landed.pitchers(records, league))
    events = landed.second_lines_of(lines) if league == "mlb" else landed.lines_of(lines)
    preview = docs("preview")
    announced = (landed.lineups_of(preview), landed.preview_stadiums(preview))
    common = (landed.games_of(docs("schedule"), league), *rows, events, landed.gaps_of(lines), *announced, days)
    if league == "mlb":
        return Landing(*common)
    return Landing(*common, landed.team_pitching(records), landed.etc_records(records), landed.game_info(records))


def read_landing(
    spark: SparkSession, root: str, league: str, days: Sequence[str] | None = None, packed: bool = False
) -> Landing:
    """Straight from the landed JSON, which is parsed at each use; a kind that has no folder is empty."""
    def docs(kind: str) -> DataFrame:
        try:
            return landed.read_documents(spark, f"{root}/{league}/{kind}", staging.KINDS[kind], packed, days)
        except AnalysisException:
            return spark.createDataFrame([], f"key STRING, {staging.KINDS[kind]}")

    return _landing(docs, league)


def read_staged(
    spark: SparkSession, root: str, mart: str, league: str, days: Sequence[str] | None = None, packed: bool = False
) -> Landing:
    """From the staged documents, after those that are new or changed were parsed."""
    stage = f"{mart}/staged"
    staging.refresh(spark, root, stage, league, days, packed)
    return _landing(lambda kind: staging.documents(spark, stage, league, kind, days), league)


def _named_games(source: Landing) -> DataFrame:
    """Games past pregame, with the team names the box score uses."""
    games = box.live_games(source.games)
    if source.info is None:
        return games.withColumn("stadium", F.lit(""))
    return (
        games.join(source.info, "game_id", "left")
        .withColumns(
            {
                "home_team_name": F.coalesce("info_home", "home_team_name"),
                "away_team_name": F.coalesce("info_away", "away_team_name"),
                "stadium": F.coalesce("stadium", F.lit("")),
            }
        )
        .drop("info_home", "info_away", "info_date")
    )


def _settled(source: Landing, league: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    broken = landed.broken_games(source.batters, source.pitchers, league)
    return (
        source.batters.join(broken, "game_id", "left_anti"),
        source.pitchers.join(broken, "game_id", "left_anti"),
        broken,
    )


def score_first_league(
    source: Landing, positions: DataFrame, costs: DataFrame,
    keep: Callable[[DataFrame], DataFrame] = cut,
) -> ScoredDays:
    """Box score, relay, positions and costs to scored rows and their ledger."""
    games = _named_games(source)
    batters, pitchers, broken = _settled(source, "kbo")
    events = source.relay.join(games.select("game_id"), "game_id", "left_semi").join(
        broken, "game_id", "left_anti"
    )
    specials = box.special_counts(source.etc_records)
    batter_rows = box.attach_game(box.batter_counters(batters, specials), games)
    pitcher_rows = box.attach_game(
        box.pitcher_counters(
            pitchers, box.team_outs_from_box(source.team_pitching), games, specials, "kbo"
        ),
        games,
    )
    # Without a home list on both sides of the ball a game keeps its box score only.
    complete = (
        batters.filter(F.col("side") == "home").select("game_id").distinct()
        .join(pitchers.filter(F.col("side") == "home").select("game_id").distinct(), "game_id")
    )
    facts = relay.relay_facts(
        events.join(complete, "game_id", "left_semi"),
        relay.starting_lineup(batters, pitchers, events), keep,
    )
    scored_b = merge.merge_batters(pos.attach_position(batter_rows, positions), facts)
    scored_b = cost.attach_batter_cost(scored_b, costs)
    scored_p = cost.attach_pitcher_cost(merge.merge_pitchers(pitcher_rows, facts), costs)
    scored_b, scored_p = keep(scored_b), keep(scored_p)
    have_log = complete.select("game_id")
    ledger = merge.play_ledger(
        scored_b.join(have_log, "game_id", "left_semi"), scored_p.join(have_log, "game_id", "left_semi"),
        facts, box.special_mentions(source.etc_records), keep,
    )
    day = games.select("game_id", "league", "game_date")
    events_out = merge.position_events(facts.credits)
    return ScoredDays(
        scored_b, scored_p, ledger.join(day, "game_id"), events_out.join(day, "game_id"), broken
    )


def score_second_league(
    source: Landing, keep: Callable[[DataFrame], DataFrame] = cut
) -> ScoredDays:
    games = _named_games(source)
    batters, pitchers, broken = _settled(source, "mlb")
    events = source.relay.join(games.select("game_id"), "game_id", "left_semi").join(
        broken, "game_id", "left_anti"
    )
    half = F.when(F.col("side") == "home", "0").otherwise("1")
    starters = pitchers.filter(F.col("pos_idx") == 0).select(
        "game_id", half.alias("half"), F.col("name").alias("pitcher")
    )
    counts = sl.outcome_counts(events, starters, sl.starting_fielders(batters), keep)
    batter_rows = box.attach_game(sl.batter_counters(batters), games).withColumn("position", F.col("pos"))
    pitcher_rows = box.attach_game(
        box.pitcher_counters(pitchers, box.team_outs_from_pitchers(pitchers), games, None, "mlb"), games
    )
    return ScoredDays(
        sl.merge_batters(batter_rows, counts), sl.merge_pitchers(pitcher_rows, counts), None, None, broken
    )


def write_scored(days: ScoredDays, gaps: DataFrame, mart: str, version: str) -> None:
    best = ("-lp", "game_id", "name")
    published.write(days.batters, mart, "batters", version, best)
    published.write(days.pitchers, mart, "pitchers", version, best)
    if days.ledger is not None:
        line = ("game_id", "name", "no", "sub")
        # Landed records are numbered inside their game, so the mart keeps its INT.
        ledger = days.ledger.withColumn("ord", F.col("ord").cast("int"))
        published.write(ledger, mart, "ledger", version, (*line, "ord"))
        published.write(days.position_events.withColumnRenamed("tag", "type"), mart, "position_events", version, line)
    published.write(days.quarantine, mart, "quarantine", version)
    published.write(gaps, mart, "gaps", version)


def finished(games: DataFrame, league: str, days: DataFrame) -> DataFrame:
    """(league, game_date, final) of ``days``: final when the day has games and each one is over or called off."""
    over = F.coalesce("cancel", F.lit(False)) | (F.col("status_code") == "RESULT")
    ends = games.groupBy("game_date").agg(F.bool_and(F.coalesce(over, F.lit(False))).alias("final"))
    return days.join(ends, "game_date", "left").select(F.lit(league).alias("league"), "game_date", F.coalesce("final", F.lit(False)).alias("final"))


def score_days(
    spark: SparkSession, root: str, mart: str, league: str, days: Sequence[str],
    positions: DataFrame | None = None, costs: DataFrame | None = None, packed: bool = False,
    roster: DataFrame | None = None, now: str | None = None,
) -> None:
    """Recompute whole days, write them as a version and publish it; a day left without rows is empty then.

    With ``roster`` and ``now``, games that soon begin have rows of their active rosters beside the scored ones.
    """
    source = read_staged(spark, root, mart, league, days, packed)
    scored = score_second_league(source) if league == "mlb" else score_first_league(source, positions, costs)
    if roster is not None:
        at = F.to_timestamp(F.lit(now))
        batters, pitchers = pregame_day(source, league, roster, positions, at)
        scored.batters, scored.pitchers = with_pregame(scored.batters, batters), with_pregame(scored.pitchers, pitchers)
    # A game that the schedule does not list belongs to the day of the folder it landed in.
    scored.quarantine = scored.quarantine.join(source.folder_days, "game_id").select("game_id", F.lit(league).alias("league"), "game_date")
    day = source.games.select("game_id", "league", "game_date")
    version = published.new_version()
    write_scored(scored, source.gaps.join(day, "game_id"), mart, version)
    if league == "kbo":
        published.write(_partials(source).withColumn("league", F.lit(league)), mart, "position_days", version)
    listed = spark.createDataFrame([(d,) for d in days], "d STRING").select(F.to_date("d").alias("game_date"))
    published.publish(finished(source.games, league, listed), mart, version)


def _batches(days: Sequence[str]) -> list[Sequence[str]]:
    """Days in parts; each is marked when it is written, so a job that ends early goes on after its last part."""
    return [days[at : at + BATCH] for at in range(0, len(days), BATCH)]


def _fill(
    spark: SparkSession, root: str, mart: str, league: str, wanted: DataFrame, positions: DataFrame | None, costs: DataFrame | None, packed: bool
) -> list[str]:
    """Score the wanted days that are not published as final. One row per day reaches the driver."""
    missing = schedule.todo(wanted, published.done(spark, mart, league)).select("game_date").collect()
    days = sorted(str(r["game_date"]) for r in missing)
    for batch in _batches(days):
        score_days(spark, root, mart, league, batch, positions, costs, packed)
    return days


def backfill(
    spark: SparkSession, root: str, mart: str, calendar: DataFrame, positions: DataFrame | None = None,
    costs: DataFrame | None = None, packed: bool = False, league: str = "kbo",
) -> list[str]:
    """Score every season day whose games were not all over when it was scored last, or that never was."""
    return _fill(spark, root, mart, league, schedule.season_days(calendar), positions, costs, packed)


def backfill_range(
    spark: SparkSession, root: str, mart: str, first: str, last: str, positions: DataFrame | None = None,
    costs: DataFrame | None = None, packed: bool = False, league: str = "kbo",
) -> list[str]:
    """The same for the days of a range."""
    return _fill(spark, root, mart, league, schedule.date_range(spark, first, last), positions, costs, packed)


def reprocess(
    spark: SparkSession, root: str, mart: str, days: Sequence[str], positions: DataFrame | None = None,
    costs: DataFrame | None = None, run_done: str | None = None, packed: bool = False, league: str = "kbo",
) -> list[str]:
    """Score listed days again; with ``run_done`` a second call goes on where the first stopped."""
    left = set(days)
    if run_done:
        left -= {str(r["game_date"]) for r in sinks.read_done(spark, run_done).where(F.col("league") == league).collect()}
    todo = sorted(left)
    for batch in _batches(todo):
        score_days(spark, root, mart, league, batch, positions, costs, packed)
        if run_done:
            marks = spark.createDataFrame([(league, d) for d in batch], "league STRING, d STRING")
            sinks.mark_done(marks.select("league", F.to_date("d").alias("game_date")), run_done)
    return todo


def _partials(source: Landing) -> DataFrame:
    return pos.day_partials(pos.fielding_rows(source.batters, source.team_pitching, _named_games(source)))


def refresh_positions(source: Landing, previous: DataFrame, end_date: str, days: int = 14) -> DataFrame:
    """Recompute registered positions over the trailing window, keeping manual ones."""
    window = pos.position_window(
        source.batters, source.team_pitching, _named_games(source), end_date, days
    )
    return pos.merge_overrides(pos.position_table(window), previous)


def refresh_if_due(
    spark: SparkSession, source: Landing, mart: str, end_date: str, now: str, days: int = 14
) -> DataFrame:
    """Registered positions, recomputed at most once an hour.

    Days that are final give the partials that were published with them; only the others are worked out again. Each refresh is written under its own time, so readers keep the earlier one until it is whole.
    """
    marker = sinks.read_refresh_marker(spark, f"{mart}/position_refresh")
    at = F.to_timestamp(F.lit(now))
    latest = marker.agg(F.date_format(F.max("refreshed_at"), "yyyyMMddHHmmss").alias("v")).first()["v"]
    current = (
        spark.read.parquet(f"{mart}/positions/refresh={latest}") if latest
        else spark.createDataFrame([], POSITIONS)
    )
    if not schedule.refresh_due(marker, at).first()["due"]:
        return current
    version = spark.range(1).select(F.date_format(at, "yyyyMMddHHmmss").alias("v")).first()["v"]
    out = f"{mart}/positions/refresh={version}"
    window = {str(date.fromisoformat(end_date) - timedelta(days=i)) for i in range(days)}
    final = sorted(window & {str(r["game_date"]) for r in published.done(spark, mart, "kbo").collect()})
    partials = _partials(source)
    kept = published.read(spark, mart, "position_days", "kbo", final) if final else None
    if kept is not None and "player_code" in kept.columns:
        others = partials.where(~F.col("game_date").isin([F.to_date(F.lit(d)) for d in final]))
        partials = others.unionByName(kept.select(*partials.columns))
    ends = spark.createDataFrame([(end_date,)], "d STRING").select(F.to_date("d").alias("end_date"))
    table = pos.rolling_table(partials, ends, days).drop("end_date")
    pos.merge_overrides(table, current).write.mode("overwrite").parquet(out)
    sinks.mark_refreshed(spark, f"{mart}/position_refresh", now)
    return spark.read.parquet(out)


def run_day(
    spark: SparkSession, root: str, mart: str, day: str, now: str, costs: DataFrame, packed: bool = False, roster: DataFrame | None = None
) -> bool:
    """One tick of a live day: nothing outside the active window, else positions and a full rescore."""
    recent = [str(date.fromisoformat(day) - timedelta(days=i)) for i in range(pos.WINDOW_DAYS)]
    source = read_staged(spark, root, mart, "kbo", recent, packed)
    today = source.games.where(F.col("game_date") == F.to_date(F.lit(day)))
    window = schedule.active_window(today, F.to_timestamp(F.lit(now))).first()
    if window is None or not window["active"]:
        return False
    positions = refresh_if_due(spark, source, mart, day, now)
    score_days(spark, root, mart, "kbo", [day], positions, costs, packed, roster, now)
    return True


def backfill_costs(spark: SparkSession, mart: str, costs: DataFrame, out: str) -> DataFrame:
    """Add the roster cost to stored days. Scores are left alone. Returns the match rate."""
    batters = cost.attach_batter_cost(published.read(spark, mart, "batters"), costs)
    pitchers = cost.attach_pitcher_cost(published.read(spark, mart, "pitchers"), costs)
    sinks.write_days(batters, f"{out}/batters")
    sinks.write_days(pitchers, f"{out}/pitchers")
    both = spark.read.parquet(f"{out}/batters").select("league", "roster_cost").unionByName(
        spark.read.parquet(f"{out}/pitchers").select("league", "roster_cost")
    )
    return cost.match_rate(both, ["league"])


def pregame_day(source: Landing, league: str, roster: DataFrame, positions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Batter and pitcher rows of the games that soon begin, with the stadium that was announced."""
    def placed(rows: DataFrame) -> DataFrame:
        named = rows.join(source.stadiums, "game_id", "left").withColumn("stadium", F.coalesce("stadium", F.lit("")))
        return named.withColumn("league", F.lit(league))

    batters, pitchers = pregame.pregame_rows(source.games, roster, source.lineups, positions, now)
    return placed(batters), placed(pitchers)


def with_pregame(scored: DataFrame, upcoming: DataFrame) -> DataFrame:
    """Scored and upcoming rows in one table; an upcoming row has no cost yet."""
    return scored.unionByName(upcoming, allowMissingColumns=True)


def season_calendar(spark: SparkSession, games: DataFrame, first: str, last: str) -> DataFrame:
    """Every day of the range, days without games included."""
    built = schedule.build_calendar(games)
    return (
        schedule.date_range(spark, first, last).join(built, "game_date", "left")
        .withColumn("games", F.coalesce("games", F.lit(0)))
    )


def regression_scan(games: DataFrame, etc_records: DataFrame) -> DataFrame:
    """Games whose grand-slam names differ between two readings, with their day."""
    return box.grand_slam_changes(etc_records).join(
        games.select("game_id", "game_date"), "game_id", "left"
    )


def ledger_quality(ledger: DataFrame) -> DataFrame:
    """Share of players whose lines do not add up without a correction line."""
    rest = F.max((F.col("text") == merge.RESIDUAL_TEXT).cast("int")).alias("corrected")
    per_player = ledger.groupBy("game_id", "name", "role").agg(rest)
    return per_player.groupBy("role").agg(
        F.count(F.lit(1)).alias("players"), F.sum("corrected").alias("corrected")
    )


