"""Roster cost by name, position and team hint.

Candidates are reduced to one row per key before any join, so a lookup never multiplies rows.
Spark broadcasts these small tables while they stay under its size threshold and shuffles beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dugout.functions import rules
from dugout.functions.text import strip
from dugout.model import COST_PITCHER_CODES


def read_costs(raw: DataFrame) -> DataFrame:
    """Usable cost rows: (kind, position, name, hint_team, cost)."""
    code, name = strip(F.col("position")), strip(F.col("name"))
    pitcher = F.col("code").isin(*COST_PITCHER_CODES)
    return (
        raw.select(
            F.coalesce(code, F.lit("")).alias("code"), F.coalesce(name, F.lit("")).alias("name"),
            rules.hint_team(strip(F.col("hint"))).alias("hint_team"),
            strip(F.col("cost").cast("string")).try_cast("int").alias("cost"),
        )
        .filter((F.col("code") != "") & (F.col("name") != "") & F.col("cost").isNotNull())
        .withColumns(
            {
                "kind": F.when(pitcher, "pitcher").otherwise("batter"),
                "position": F.when(pitcher, F.col("code")).otherwise(rules.cost_position(F.col("code"))),
            }
        )
        .filter(F.col("position").isNotNull())
        .drop("code")
    )


def _candidates(costs: DataFrame, keys: list[str], tag: str) -> tuple[DataFrame, DataFrame]:
    per_key = costs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(f"{tag}_n"), F.min("cost").alias(f"{tag}_only")
    )
    per_team = (
        costs.filter(F.col("hint_team").isNotNull())
        .groupBy(*keys, F.col("hint_team").alias("team"))
        .agg(F.count(F.lit(1)).alias(f"{tag}_tn"), F.min("cost").alias(f"{tag}_team"))
        .filter(F.col(f"{tag}_tn") == 1).drop(f"{tag}_tn")
    )
    return per_key, per_team


def _tier(tag: str) -> Column:
    return F.when(F.col(f"{tag}_n") == 1, F.col(f"{tag}_only")).otherwise(F.col(f"{tag}_team"))


def attach_batter_cost(rows: DataFrame, costs: DataFrame) -> DataFrame:
    """Exact (position, name) first; by name only when that has no candidate at all."""
    batters = costs.filter(F.col("kind") == "batter")
    exact, exact_team = _candidates(batters, ["position", "name"], "e")
    loose, loose_team = _candidates(batters, ["name"], "l")
    return (
        rows.join(exact, ["position", "name"], "left")
        .join(exact_team, ["position", "name", "team"], "left")
        .join(loose, ["name"], "left")
        .join(loose_team, ["name", "team"], "left")
        .withColumn("roster_cost", F.when(F.col("e_n").isNotNull(), _tier("e")).otherwise(_tier("l")))
        .select(*[c for c in rows.columns if c != "roster_cost"], "roster_cost")
    )


def attach_pitcher_cost(rows: DataFrame, costs: DataFrame) -> DataFrame:
    found, found_team = _candidates(costs.filter(F.col("kind") == "pitcher"), ["name"], "p")
    return (
        rows.join(found, ["name"], "left")
        .join(found_team, ["name", "team"], "left")
        .withColumn("roster_cost", _tier("p"))
        .select(*[c for c in rows.columns if c != "roster_cost"], "roster_cost")
    )


def match_rate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows found a cost."""
    return rows.groupBy(*keys).agg(
        F.count("roster_cost").alias("matched"), F.count(F.lit(1)).alias("total")
    )
