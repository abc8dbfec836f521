"""Points, flags and display values."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

from dugout.model import (
    BATTER_ONCE, BATTER_WEIGHTS, LEAGUE_RULES, PITCHER_EXCLUSIVE, PITCHER_WEIGHTS, STARTER,
)


def as_count(value: Column) -> Column:
    return F.coalesce(value.cast("int"), F.lit(0))


def once(value: Column, points: int) -> Column:
    return F.when(as_count(value) != 0, F.lit(points)).otherwise(F.lit(0))


def batter_lp(weights: dict[str, int] = BATTER_WEIGHTS) -> Column:
    return reduce(
        add,
        [
            once(F.col(k), w) if k in BATTER_ONCE else as_count(F.col(k)) * w
            for k, w in weights.items()
        ],
    )


def pitcher_lp(weights: dict[str, int] = PITCHER_WEIGHTS) -> Column:
    paired = {k for pair in PITCHER_EXCLUSIVE for k in pair}
    linear = [as_count(F.col(k)) * w for k, w in weights.items() if k not in paired]
    either = [
        F.when(as_count(F.col(a)) != 0, F.lit(weights[a]))
        .when(as_count(F.col(b)) != 0, F.lit(weights[b]))
        .otherwise(F.lit(0))
        for a, b in PITCHER_EXCLUSIVE
    ]
    return reduce(add, linear + either)


def hit_by_pitch(bbhp: Column, bb: Column) -> Column:
    return F.greatest(bbhp - bb, F.lit(0))


def start_flags(
    outs: Column, er: Column, r: Column, hit: Column, free_bases: Column,
    is_starter: Column, is_final: Column, team_outs: Column, league: str,
) -> dict[str, Column]:
    """Complete-game and quality-start flags. ``free_bases`` is what a perfect game must lack."""
    limit = LEAGUE_RULES[league]["qsplus_er"]
    cg = is_final & is_starter & (outs > 0) & (outs == F.coalesce(team_outs, F.lit(0)))
    qsplus = is_starter & (outs >= 21) & (er <= limit)
    return {
        "QS": is_starter & (outs >= 18) & (er <= 3) & ~qsplus,
        "QSPLUS": qsplus,
        "PERFECT": cg & (hit == 0) & (free_bases == 0),
        "NOHIT": cg & (hit == 0),
        "SHO": cg & (r == 0),
        "CG": cg,
    }


def decision_flags(wls: Column) -> dict[str, Column]:
    letter = F.coalesce(wls, F.lit(""))
    return {
        "HOLD": (letter == "홀").cast("int"),
        "SAVE": (letter == "세").cast("int"),
        "BLOWN": (letter == "블").cast("int"),
    }


def save_opportunity(team_won: Column, margin: Column, outs: Column) -> Column:
    close = margin.between(1, 3) & (outs >= 3)
    return margin.isNotNull() & F.coalesce(team_won, F.lit(False)) & (close | (outs >= 9))


def lp_band(lp: Column, warm: int = 60) -> Column:
    """``warm`` is 60 on the board and 80 in the report."""
    return F.when(lp >= 150, "hot").when(lp >= warm, "warm").when(lp < 0, "cool").otherwise("")


def cost_value(lp: Column, cost: Column) -> Column:
    return F.try_divide(lp.cast("double"), F.nullif(cost, F.lit(0)).cast("double"))


def history_value(lp: Column, threshold: Column, cost: Column, relative: bool, per_cost: bool) -> Column:
    """Value a history chart shows; without a usable cost it falls back to the plain value."""
    above = lp - threshold
    if relative and per_cost:
        return F.coalesce(cost_value(above, cost), above.cast("double"))
    if relative:
        return above.cast("double")
    if per_cost:
        return F.coalesce(cost_value(lp, cost), lp.cast("double"))
    return lp.cast("double")


def is_starter_role(role: Column) -> Column:
    return role == STARTER


def merged(*keys: str) -> Column:
    """One table cell that adds several counters."""
    return reduce(add, [as_count(F.col(k)) for k in keys])


def group_total(items: tuple[tuple[str, bool], ...], weights: dict[str, int]) -> Column:
    return reduce(
        add,
        [
            once(F.col(k), weights.get(k, 0)) if flag else as_count(F.col(k)) * weights.get(k, 0)
            for k, flag in items
        ],
    )
