"""Answers over scored days: boards, category totals, tiles, thresholds and history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from dugout.functions import rules, scoring
from dugout.model import (
    BATTER_CATEGORIES, BATTER_WEIGHTS, BOARD_BATTER_GROUPS, BOARD_PITCHER_GROUPS, CATCHER, DH,
    INFIELD, OUTFIELD, PITCHER_CATEGORIES_RELIEVER, PITCHER_CATEGORIES_SHARED,
    PITCHER_CATEGORIES_STARTER, PITCHER_WEIGHTS, RELIEVER, STARTER,
)
from dugout.operators.scan import kth_largest, ranked

# Export columns.
BATTER_EXPORT = (
    "rank", "name", "position", "team", "opponent", "stadium", "game_date", "lp", "ab",
    "H", "2B", "3B", "HR", "RBI", "R", "BB", "HBP", "K", "SB", "CS", "GDP", "SACBUNT", "E",
    "CYCLE", "GRANDSLAM",
)
PITCHER_EXPORT = (
    "rank", "name", "role", "team", "opponent", "stadium", "game_date", "lp", "inn",
    "H", "ER", "BB", "HBP", "K", "WP", "BK", "HOLD", "SAVE", "BLOWN", "QSPLUS", "QS",
    "CG", "SHO", "NOHIT", "PERFECT",
)
# Columns of the board, as (header, counters added up in the cell).
BOARD_BATTER_COLUMNS = (
    ("name", ("name",)), ("position", ("position",)), ("opponent", ("opponent",)),
    ("stadium", ("stadium",)), ("lp", ("lp",)), ("cost", ("roster_cost",)), ("ab", ("ab",)),
    ("H", ("H",)), ("2B", ("2B",)), ("3B", ("3B",)), ("HR", ("HR",)), ("RBI", ("RBI",)), ("R", ("R",)),
    ("BB_HBP", ("BB", "HBP")), ("K", ("K",)), ("SB", ("SB",)), ("CS_PICKOFF", ("CS", "PICKOFF")),
    ("GDP", ("GDP",)), ("SACFLY", ("SACFLY",)), ("SACBUNT", ("SACBUNT",)), ("E", ("E",)),
    ("ASSIST", ("ASSIST",)), ("OF_ASSIST", ("OF_ASSIST",)), ("DP_FIELD", ("DP_FIELD",)),
    ("TP_FIELD", ("TP_FIELD",)), ("CS_CATCHER", ("CS_CATCHER",)),
    ("SB_ALLOWED_CATCHER", ("SB_ALLOWED_CATCHER",)), ("CYCLE", ("CYCLE",)),
    ("GRANDSLAM", ("GRANDSLAM",)),
)
BOARD_PITCHER_COLUMNS = (
    ("name", ("name",)), ("role", ("role",)), ("opponent", ("opponent",)), ("stadium", ("stadium",)),
    ("lp", ("lp",)), ("cost", ("roster_cost",)), ("inn", ("inn",)), ("H", ("H",)), ("ER", ("ER",)),
    ("BB_HBP", ("BB", "HBP")), ("K", ("K",)), ("2B_A", ("2B_A",)), ("3B_A", ("3B_A",)),
    ("HR", ("HR",)), ("WP", ("WP",)), ("BK", ("BK",)), ("INHERITED_SCORED", ("INHERITED_SCORED",)),
    ("INHERITED_STRANDED", ("INHERITED_STRANDED",)), ("CS_A_PICKOFF_A", ("CS_A", "PICKOFF_A")),
    ("SB_ALLOWED", ("SB_ALLOWED",)), ("HOLD", ("HOLD",)), ("SAVE", ("SAVE",)),
    ("SAVE_OPP", ("SAVE_OPP",)), ("BLOWN", ("BLOWN",)), ("QSPLUS", ("QSPLUS",)), ("QS", ("QS",)),
    ("CG", ("CG",)), ("SHO", ("SHO",)), ("NOHIT", ("NOHIT",)), ("PERFECT", ("PERFECT",)),
)


def leaderboard(
    rows: DataFrame, keys: Sequence[str], ties: Sequence[str], spread: Column | None = None
) -> DataFrame:
    """1..n by points per day; equal points are ordered by ``spread`` and ``ties``."""
    return ranked(rows, keys, "lp", ties, "rank", spread)


def export(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.select(*[c for c in columns if c in rows.columns])


#: Who can have a counter: the rules of the game, not of a player. Counters not listed are everybody's.
FIELD_POSITIONS = frozenset((CATCHER, *INFIELD, *OUTFIELD))
BATTER_COUNTER_OWNERS = {
    "ASSIST": FIELD_POSITIONS - frozenset(OUTFIELD),
    "OF_ASSIST": frozenset(OUTFIELD),
    "CS_CATCHER": frozenset((CATCHER,)),
    "SB_ALLOWED_CATCHER": frozenset((CATCHER,)),
    "DP_FIELD": FIELD_POSITIONS,
    "TP_FIELD": FIELD_POSITIONS,
}
PITCHER_COUNTER_OWNERS = {
    **dict.fromkeys(("QS", "QSPLUS", "CG", "SHO", "NOHIT", "PERFECT"), STARTER),
    **dict.fromkeys(("HOLD", "SAVE", "SAVE_OPP", "BLOWN", "INHERITED_SCORED", "INHERITED_STRANDED"), RELIEVER),
}


def hidden_batter_columns(position: str | None) -> set[str]:
    """Counters that nobody at this position can have, and the position itself; nothing when no position is chosen."""
    if position is None:
        return set()
    known = position in FIELD_POSITIONS or position == DH
    return {"position", *(c for c, owners in BATTER_COUNTER_OWNERS.items() if known and position not in owners)}


def hidden_pitcher_columns(role: str | None) -> set[str]:
    if role not in (STARTER, RELIEVER):
        return set()
    return {"role", *(c for c, owner in PITCHER_COUNTER_OWNERS.items() if owner != role)}


def flat_board(
    rows: DataFrame, columns: Sequence[tuple[str, tuple[str, ...]]], hidden: set[str], keep: Sequence[str] = ()
) -> DataFrame:
    """Board columns without the hidden ones; a merged cell goes when any part is hidden."""
    cells = []
    for header, parts in columns:
        if hidden.intersection(parts) or not set(parts).issubset(rows.columns):
            continue
        cells.append((F.col(parts[0]) if len(parts) == 1 else scoring.merged(*parts)).alias(header))
    return rows.select(*keep, *cells)


def grouped_board(
    rows: DataFrame, groups: dict, weights: dict[str, int], hidden: set[str], keep: Sequence[str] = (),
    expanded: Sequence[str] = (),
) -> DataFrame:
    """One column of points per group; ``expanded`` groups show their counters instead."""
    cells = []
    for group, items in groups.items():
        visible = tuple(i for i in items if i[0] not in hidden)
        if not visible:
            continue
        if group in expanded:
            cells += [scoring.as_count(F.col(k)).alias(k) for k, _ in visible]
        else:
            cells.append(scoring.group_total(visible, weights).alias(group))
    return rows.select(*keep, *cells)


def batter_group_board(rows: DataFrame, position: str | None, keep: Sequence[str] = ()) -> DataFrame:
    return grouped_board(rows, BOARD_BATTER_GROUPS, BATTER_WEIGHTS, hidden_batter_columns(position), keep)


def pitcher_group_board(rows: DataFrame, role: str | None, keep: Sequence[str] = ()) -> DataFrame:
    return grouped_board(rows, BOARD_PITCHER_GROUPS, PITCHER_WEIGHTS, hidden_pitcher_columns(role), keep)


def filter_batters(
    rows: DataFrame, query: str = "", position: str | None = None, merge_outfield: bool = False
) -> DataFrame:
    """Text and position filter. The second league shows the outfield as one position."""
    out = rows.filter(rules.matches_search(F.col("name"), F.col("team"), query))
    if position is None:
        return out
    wanted = OUTFIELD if merge_outfield and position == "외야수" else (position,)
    return out.filter(F.col("position").isin(*wanted))


def filter_pitchers(rows: DataFrame, query: str = "", role: str | None = None) -> DataFrame:
    out = rows.filter(rules.matches_search(F.col("name"), F.col("team"), query))
    return out if role is None else out.filter(F.col("role") == role)


def sort_board(rows: DataFrame, column: str, descending: bool = True, text: bool = False) -> DataFrame:
    """Order for display; a missing number counts as zero."""
    value = F.col(column) if text else F.coalesce(F.col(column).cast("double"), F.lit(0.0))
    return rows.orderBy(value.desc() if descending else value.asc())


def _items(categories, weights: dict[str, int]) -> Column:
    cells = []
    for group, label, key, flag in categories:
        key, _, info = key.partition(":")
        parts = key.split("+")
        count = scoring.merged(*parts)
        if info:
            points = F.lit(0)
        elif flag:
            points = scoring.once(F.col(key), weights.get(key, 0))
        else:
            points = sum(
                (scoring.as_count(F.col(p)) * weights.get(p, 0) for p in parts[1:]),
                scoring.as_count(F.col(parts[0])) * weights.get(parts[0], 0),
            )
        cells.append(
            F.struct(
                F.lit(group).alias("category"), F.lit(label).alias("label"), count.alias("count"),
                points.cast("int").alias("points"), F.lit(flag).alias("flag"),
            )
        )
    return F.array(*cells)


def batter_category_items(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per player and category item; no shuffle."""
    item = F.explode(_items(BATTER_CATEGORIES, BATTER_WEIGHTS)).alias("i")
    return rows.select(*keep, item).select(*keep, "i.*")


def pitcher_category_items(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Starters and relievers have their own groups."""
    starter = _items(PITCHER_CATEGORIES_SHARED + PITCHER_CATEGORIES_STARTER, PITCHER_WEIGHTS)
    reliever = _items(PITCHER_CATEGORIES_SHARED + PITCHER_CATEGORIES_RELIEVER, PITCHER_WEIGHTS)
    item = F.explode(F.when(F.col("role") == STARTER, starter).otherwise(reliever)).alias("i")
    return rows.select(*keep, item).select(*keep, "i.*")


def _category_points(categories, weights: dict[str, int]) -> Column:
    """One entry per category: the points of its items in this row."""
    def points(item: Column) -> Column:
        return F.coalesce(item["points"], F.lit(0)).cast("bigint")

    cells: dict[str, Column] = {}
    for entry in categories:
        group, item = entry[0], F.get(_items((entry,), weights), F.lit(0))
        cells[group] = cells[group] + points(item) if group in cells else points(item)
    return F.array(*[F.struct(F.lit(g).alias("category"), p.alias("points")) for g, p in cells.items()])


def category_cube(batters: DataFrame, pitchers: DataFrame, sides: Sequence[str]) -> DataFrame:
    """side, key, category, rows, points: category totals of every value of each of ``sides``, all in one pass.

    A row's items are added up by category before anything is shuffled, so a row is ``len(sides)`` times its
    categories, and partial sums leave each task once per key. A null key is told from the total of another side.
    """
    keep = list(sides)
    starter = _category_points(PITCHER_CATEGORIES_SHARED + PITCHER_CATEGORIES_STARTER, PITCHER_WEIGHTS)
    reliever = _category_points(PITCHER_CATEGORIES_SHARED + PITCHER_CATEGORIES_RELIEVER, PITCHER_WEIGHTS)
    rows = batters.select(*keep, F.explode(_category_points(BATTER_CATEGORIES, BATTER_WEIGHTS)).alias("i")).unionByName(
        pitchers.select(*keep, F.explode(F.when(F.col("role") == STARTER, starter).otherwise(reliever)).alias("i"))
    ).select(*[F.col(k).cast("string").alias(k) for k in keep], F.col("i.category").alias("category"), F.col("i.points").alias("points"))
    category = F.col("category")
    cube = rows.groupingSets([[F.col(k), category] for k in keep], *[F.col(k) for k in keep], category).agg(
        *[F.grouping(k).alias(f"without_{k}") for k in keep],
        F.count(F.lit(1)).alias("rows"), F.sum("points").alias("points"),
    )
    side = F.coalesce(*[F.when(F.col(f"without_{k}") == 0, F.lit(k)) for k in keep])
    key = F.coalesce(*[F.when(F.col(f"without_{k}") == 0, F.col(k)) for k in keep])
    return cube.select(side.alias("side"), key.alias("key"), "category", "rows", "points")


def category_totals(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points per category. Outs repeat two running items, so totals may exceed the score."""
    return items.groupBy(*keys, "category").agg(F.sum("points").alias("points"))


def visible_items(items: DataFrame) -> DataFrame:
    """Flags always, other items only when they happened."""
    return items.filter(F.col("flag") | (F.col("count") != 0))


def day_tiles(batters: DataFrame, pitchers: DataFrame) -> DataFrame:
    """Games, best batter, best pitcher and row counts per day."""
    def best(rows: DataFrame, tag: str) -> list[Column]:
        top = F.struct("lp", F.struct("name", "team").alias("who"))
        return [F.max(top).alias(f"{tag}_top"), F.count(F.lit(1)).alias(f"{tag}_rows")]

    pairs = batters.groupBy("game_date", "team", "opponent").agg(F.lit(1).alias("x"))
    games = pairs.groupBy("game_date").agg(F.floor(F.count(F.lit(1)) / 2).cast("bigint").alias("games"))
    b = batters.groupBy("game_date").agg(*best(batters, "batter"))
    p = pitchers.groupBy("game_date").agg(*best(pitchers, "pitcher"))
    zero = F.lit(0)
    return (
        b.join(p, "game_date", "full").join(games, "game_date", "left")
        .select(
            "game_date", F.coalesce("games", zero).cast("bigint").alias("games"),
            *[
                c
                for tag in ("batter", "pitcher")
                for c in (
                    F.coalesce(f"{tag}_top.lp", zero).alias(f"top_{tag}_lp"),
                    F.coalesce(f"{tag}_top.who.name", F.lit("-")).alias(f"top_{tag}"),
                    F.coalesce(f"{tag}_rows", zero).cast("bigint").alias(f"{tag}_rows"),
                )
            ],
        )
    )


def latest_date(rows: DataFrame) -> DataFrame:
    return rows.agg(F.max("game_date").alias("latest"))


def distinct_years(rows: DataFrame) -> DataFrame:
    return rows.select(F.year("game_date").alias("year")).distinct()


# Rank whose score is the threshold of each pool.
POOL_RANK = {"starter": 3, "reliever": 5, "outfield": 5, "DH": 5, "position": 2}
DEEPEST = max(POOL_RANK.values())
POOL_KEYS = ("game_date", "pool", "pool_key")


def _normalised() -> Column:
    own = F.nullif(F.coalesce(F.col("board_position"), F.lit("")), F.lit(""))
    return rules.normalise_position(F.coalesce(own, F.col("position")))


def with_pool(rows: DataFrame) -> DataFrame:
    """The pool a player is measured in. ``kind`` is batter or pitcher."""
    if "board_position" not in rows.columns:
        rows = rows.withColumn("board_position", F.lit(None).cast("string"))
    norm = F.col("norm_position")
    pool = (
        F.when(F.col("role") == STARTER, "starter")
        .when(F.col("role") == RELIEVER, "reliever")
        .when(norm.contains("지명"), "DH")
        .when(rules.is_outfield(norm), "outfield")
        .otherwise("position")
    )
    return (
        rows.withColumn("norm_position", _normalised())
        .withColumn("pool", pool)
        .withColumn("pool_key", F.when(F.col("pool") == "position", norm).otherwise(F.lit("")))
    )


def pool_members(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per player and pool: game_date, the columns of ``keep``, lp, pool, pool_key."""
    pooled = with_pool(rows)
    norm = F.col("norm_position")
    pitcher = F.col("kind") == "pitcher"

    def entry(pool: str, key: Column, member: Column) -> Column:
        return F.when(member, F.struct(F.lit(pool).alias("pool"), key.alias("pool_key")))

    blank = F.lit("")
    entries = F.array(
        entry("starter", blank, pitcher & (F.col("role") == STARTER)),
        entry("reliever", blank, pitcher & (F.col("role") == RELIEVER)),
        entry("outfield", blank, rules.is_outfield(norm)),
        entry("DH", blank, F.col("kind") == "batter"),
        entry("position", norm, F.lit(True)),
    )
    return pooled.select(
        "game_date", *keep, "lp", F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")
    ).select("game_date", *keep, "lp", "e.*")


def _pool_rank() -> Column:
    wanted = F.lit(POOL_RANK["position"])
    for pool, rank in POOL_RANK.items():
        wanted = F.when(F.col("pool") == pool, rank).otherwise(wanted)
    return wanted


def thresholds(rows: DataFrame) -> DataFrame:
    """k-th best score per (day, pool, pool_key); a pool with fewer rows has none."""
    return kth_largest(pool_members(rows), [*POOL_KEYS], "lp", _pool_rank(), DEEPEST)


def _best_scores(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, top): the best scores, ``DEEPEST`` at most, the highest first."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("lp")))
    few = members.withColumn("__place", place).filter(F.col("__place") <= DEEPEST)
    return few.groupBy(*keys).agg(F.sort_array(F.collect_list("lp"), asc=False).alias("top"))


def pool_states(rows: DataFrame, game: str = "game_id") -> DataFrame:
    """What a threshold needs of each game: its best scores in every pool, a bounded list."""
    return _best_scores(pool_members(rows, [game]), [*POOL_KEYS, game])


def replace_states(states: DataFrame, games: DataFrame, fresh: DataFrame, game: str = "game_id") -> DataFrame:
    """``states`` with those of the games scored again (game_date, game) taken from ``fresh``.

    Scores fall as well as rise when a line is corrected, so a game's state is replaced and never merged with itself.
    """
    return states.join(games, ["game_date", game], "left_anti").unionByName(fresh)


def merge_states(states: DataFrame) -> DataFrame:
    """(day, pool, pool_key, top) over all games. Merged states can be merged again, in any order."""
    members = states.select(*POOL_KEYS, F.explode("top").alias("lp"))
    return _best_scores(members, POOL_KEYS)


def thresholds_of(states: DataFrame) -> DataFrame:
    """:func:`thresholds` from states, without the rows they stand for."""
    merged = merge_states(states)
    return merged.filter(F.size("top") >= _pool_rank()).select(*POOL_KEYS, F.element_at("top", _pool_rank()).alias("kth"))


def player_history(rows: DataFrame, relative: bool = True, per_cost: bool = True) -> DataFrame:
    """One row per player and day, with the day's threshold and the value a chart shows.

    When a name occurs twice in a team on one day the first row counts, batters before pitchers.
    """
    place = F.struct(
        F.when(F.col("kind") == "batter", 0).otherwise(1).alias("k"), (-F.col("lp")).alias("l"), "row_id"
    )
    first = with_pool(rows).groupBy("game_date", "name", "team").agg(
        F.min_by(
            F.struct("lp", "roster_cost", "pool", "pool_key", "position", "role"), place
        ).alias("r")
    ).select("game_date", "name", "team", "r.*")
    limit = thresholds(rows).withColumnRenamed("kth", "threshold")
    joined = first.join(limit, ["game_date", "pool", "pool_key"], "left").withColumn(
        "threshold", F.coalesce("threshold", F.lit(0))
    )
    lp, cost = F.col("lp"), F.col("roster_cost")
    return joined.withColumns(
        {
            "relative_value": lp - F.col("threshold"),
            "cost_value": scoring.cost_value(lp, cost),
            "shown": scoring.history_value(lp, F.col("threshold"), cost, relative, per_cost),
        }
    )


def history_scale(history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Longest bar of a chart, at least one."""
    return history.groupBy(*keys).agg(F.greatest(F.lit(1.0), F.max(F.abs("shown"))).alias("scale"))
