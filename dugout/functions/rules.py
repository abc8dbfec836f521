"""Position, team and time rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from dugout.functions.text import strip
from dugout.model import (
    CATCHER, COST_POSITION_NAMES, DH, INFIELD, OUTFIELD, OUTFIELD_NORMALISED, TEAMS,
)


def field_group(position: Column) -> Column:
    return (
        F.when(position == CATCHER, "포수")
        .when(position.isin(*INFIELD), "내야")
        .when(position.isin(*OUTFIELD), "외야")
    )


def position_allowed(event_pos: Column, registered: Column, mode: Column, dh_counts: Column) -> Column:
    """Whether a fielding credit made at ``event_pos`` counts for a player registered elsewhere.

    Mode 1: only at that position. Mode 2: within infield or outfield. Mode 3: always.
    """
    own = F.coalesce(registered, F.lit(""))
    return (
        F.when(own == DH, dh_counts)
        .when(own == "", F.lit(True))
        .when(mode == 1, event_pos == own)
        .when(mode == 2, field_group(event_pos).eqNullSafe(field_group(own)))
        .otherwise(F.lit(True))
    )


def hint_team(hint: Column) -> Column:
    """First team name the hint starts with."""
    text = F.coalesce(hint, F.lit(""))
    out = None
    for team in TEAMS:
        out = F.when(text.startswith(team), team) if out is None else out.when(text.startswith(team), team)
    return out


def cost_position(code: Column) -> Column:
    out = None
    for key, name in COST_POSITION_NAMES.items():
        out = F.when(code == key, name) if out is None else out.when(code == key, name)
    return out


def normalise_position(position: Column) -> Column:
    return F.upper(F.regexp_replace(strip(F.coalesce(position, F.lit(""))), r"[/\s]+", ""))


def is_outfield(normalised: Column) -> Column:
    return normalised.isin(*OUTFIELD_NORMALISED)


def korea_instant(text: Column) -> Column:
    """KST wall clock text to an instant; NULL when it cannot be read."""
    return F.to_utc_timestamp(F.try_to_timestamp(text), "Asia/Seoul")


def in_pregame_window(game_datetime: Column, now: Column, hours: int = 2) -> Column:
    """From ``hours`` before the start on; there is no upper bound."""
    start = korea_instant(game_datetime)
    return F.coalesce(now >= start - F.expr(f"INTERVAL {int(hours)} HOURS"), F.lit(False))


def compact_date(text: Column) -> Column:
    return F.to_date(text.try_cast("string"), "yyyyMMdd")


def date_label(day: Column) -> Column:
    return F.date_format(day, "MM'월 'dd'일'")


def month_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def matches_search(name: Column, team: Column, query: str) -> Column:
    """Case-blind search in name and team."""
    return F.lower(F.concat(F.coalesce(name, F.lit("")), F.coalesce(team, F.lit("")))).contains(
        query.strip().lower()
    )
