"""The second league: its relay names outcomes only, so the merge adds more to the box."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from dugout.functions import relaytext as rt, scoring
from dugout.model import BATTER_COUNTERS, BATTER_FLAGS, NON_FIELDING_B
from dugout.operators.relay import by_chunk
from dugout.operators.scan import scan

PLAYER = ["game_id", "name"]
BATTER_ADDED = ("2B", "3B", "GDP", "SACFLY", "CS", "PICKOFF", "GRANDSLAM")
PITCHER_ADDED = ("2B_A", "3B_A", "CS_A", "SB_ALLOWED", "PICKOFF_A")


@dataclass
class OutcomeCounts:
    batters: DataFrame   # (game_id, name, counters.., ADVANCE)
    pitchers: DataFrame
    errors: DataFrame    # (game_id, name, errors)


def batter_counters(batters: DataFrame) -> DataFrame:
    """Counters the box gives directly; everything else starts at zero."""
    zero = F.lit(0)
    box = {"R": "run", "H": "hit", "BB": "bb", "HR": "hr", "RBI": "rbi", "SB": "sb", "HBP": "hbp", "K": "kk"}
    keep = [c for c in batters.columns if c not in {*box.values(), "pa_codes", "substitute_in"}]
    return batters.select(
        *keep,
        *[
            F.coalesce(F.col(box[c]), zero).alias(c) if c in box
            else (F.lit(False) if c in BATTER_FLAGS else zero).alias(c)
            for c in BATTER_COUNTERS
        ],
    )


def parse_lines(events: DataFrame) -> DataFrame:
    text, kind = F.col("text"), F.col("kind")
    return events.withColumn("kind", rt.line_kind_b(text)).withColumns(
        {
            "name": rt.line_name_b(text, kind),
            "play_desc": F.when(kind == "play", F.regexp_extract(text, rt.PLAY, 2)),
            "error_pos": rt.error_position_b(text, kind),
            "home_line": rt.is_plain_home(text),
            "advance_line": rt.is_unmarked_advance(text, rt.ADVANCE_MARKERS_B),
        }
    )


def outcome_state(lines: DataFrame, starters: DataFrame | None) -> DataFrame:
    """Lines with the pitcher in charge and the facts of their plate appearance."""
    group = Window.partitionBy("game_id", "chunk", "no")
    facts = lines.drop("text").withColumns(
        {
            "group_homes": F.sum(F.col("home_line").cast("int")).over(group),
            "group_advance": F.max("advance_line").over(group),
        }
    )
    return scan(
        facts, ["game_id", "half"], ["no", "sub"], "chunk",
        {"pitcher": (F.when(F.col("kind") == "sub", F.col("name")), True)}, initial=starters,
        fold="half",
    )


def outcome_counts(
    events: DataFrame,
    starters: DataFrame | None,
    fielders: DataFrame,
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> OutcomeCounts:
    """Counts per batter, pitcher and fielder.

    ``starters`` is (game_id, half, pitcher); ``fielders`` is (game_id, half, position, name).
    """
    lines = parse_lines(by_chunk(events))
    state = keep(outcome_state(lines, starters))
    kind, desc, play = F.col("kind"), F.col("play_desc"), F.col("play")
    rows = state.withColumn("play", rt.play_class(desc))

    def when(condition: Column) -> Column:
        return F.count_if(F.coalesce(condition, F.lit(False))).cast("int")

    is_play = kind == "play"
    batters = rows.filter(kind.isin("play", "caught", "pickoff")).groupBy(*PLAYER).agg(
        when(is_play & (play == "2B")).alias("2B"), when(is_play & (play == "3B")).alias("3B"),
        when(is_play & (play == "GDP")).alias("GDP"), when(is_play & (play == "SACFLY")).alias("SACFLY"),
        when(kind == "caught").alias("CS"), when(kind == "pickoff").alias("PICKOFF"),
        when(is_play & (play == "HR") & (F.col("group_homes") >= 3)).alias("GRANDSLAM"),
        when(is_play & rt.is_productive_out(desc) & F.col("group_advance")).alias("ADVANCE"),
    )
    double = desc.contains("2루타")
    pitchers = (
        rows.filter(F.col("pitcher").isNotNull() & kind.isin("play", "caught", "pickoff", "steal"))
        .groupBy("game_id", F.col("pitcher").alias("name"))
        .agg(
            when(is_play & double).alias("2B_A"),
            when(is_play & ~double & desc.contains("3루타")).alias("3B_A"),
            when(kind == "caught").alias("CS_A"), when(kind == "steal").alias("SB_ALLOWED"),
            when(kind == "pickoff").alias("PICKOFF_A"),
        )
    )
    errors = (
        rows.filter(F.col("error_pos").isNotNull())
        .groupBy("game_id", "half", F.col("error_pos").alias("position"))
        .agg(F.count(F.lit(1)).alias("c"))
        .join(fielders, ["game_id", "half", "position"])
        .groupBy(*PLAYER).agg(F.sum("c").cast("int").alias("errors"))
    )
    return OutcomeCounts(batters, pitchers, errors)


def starting_fielders(batters: DataFrame) -> DataFrame:
    """Fielder per position at the start; the later row wins."""
    half = F.when(F.col("side") == "home", "0").otherwise("1")
    return (
        batters.filter((F.coalesce("pos", F.lit("")) != "") & ~F.col("pos").isin(*NON_FIELDING_B))
        .groupBy("game_id", half.alias("half"), F.col("pos").alias("position"))
        .agg(F.max_by("name", "pos_idx").alias("name"))
    )


def merge_batters(batters: DataFrame, counts: OutcomeCounts) -> DataFrame:
    """Add the relay's counts. Productive outs replace SACBUNT; the cycle is redone on a change."""
    zero = F.lit(0)
    extra = counts.batters.select(*PLAYER, *[F.col(c).alias(f"__{c}") for c in (*BATTER_ADDED, "ADVANCE")])
    joined = batters.join(extra, PLAYER, "left").join(counts.errors, PLAYER, "left")
    added = {c: F.coalesce(f"__{c}", zero) for c in (*BATTER_ADDED, "ADVANCE")}
    errors = F.coalesce("errors", zero)
    changed = errors != 0
    for value in added.values():
        changed = changed | (value != 0)
    values = {c: F.col(c) + added[c] for c in BATTER_ADDED}
    values["SACBUNT"] = F.when(added["ADVANCE"] != 0, added["ADVANCE"]).otherwise(F.col("SACBUNT"))
    values["E"] = F.col("E") + errors
    values["__changed"] = changed
    merged = joined.withColumns(values)
    hr, two, three = F.col("HR"), F.col("2B"), F.col("3B")
    cycle = (F.col("H") - two - three - hr > 0) & (two > 0) & (three > 0) & (hr > 0)
    return (
        merged.withColumn("CYCLE", F.when(F.col("__changed"), cycle).otherwise(F.col("CYCLE")))
        .drop("__changed", "errors", *[f"__{c}" for c in (*BATTER_ADDED, "ADVANCE")])
        .withColumn("lp", scoring.batter_lp())
    )


def merge_pitchers(pitchers: DataFrame, counts: OutcomeCounts) -> DataFrame:
    extra = counts.pitchers.select(*PLAYER, *[F.col(c).alias(f"__{c}") for c in PITCHER_ADDED])
    return (
        pitchers.join(extra, PLAYER, "left")
        .withColumns({c: F.col(c) + F.coalesce(f"__{c}", F.lit(0)) for c in PITCHER_ADDED})
        .drop(*[f"__{c}" for c in PITCHER_ADDED])
        .withColumn("lp", scoring.pitcher_lp())
    )
