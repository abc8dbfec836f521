"""Every operator as a query over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
import uuid

from pyspark.sql import DataFrame, SparkSession, types as T, functions as F

from dugout.functions import innings, plate, relaytext as rt, rules, scoring
from dugout.model import (
    BATTER_COUNTERS, DH, FIELD_COUNTERS, PITCHER_COUNTERS, RELIEVER, STARTER,
)
from dugout.operators import (
    boards, box, cost, merge, positions as pos, pregame, relay, roster, schedule, second_league as sl,
)
from dugout.plans import bindings as b
from dugout.session import cut, shared_folder
from dugout.sources import landed, sinks, tables
from dugout.streaming import linestore

Query = Callable[[SparkSession, str], DataFrame]
NOW = "1998-06-15 03:00:00"
WINDOW_END, WINDOW_DAYS = "2000-12-31", 400


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers and flags as BIGINT, dates as text, so both engines return the same types."""
    def column(f: T.StructField):
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)):
            return F.col(f"`{f.name}`").cast("bigint").alias(f.name)
        if isinstance(f.dataType, T.DateType):
            return F.date_format(f"`{f.name}`", "yyyy-MM-dd").alias(f.name)
        return F.col(f"`{f.name}`")

    return df.select(*[column(f) for f in df.schema.fields])


# --- box score ------------------------------------------------------------------------------


def pa_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.line_batters(spark, sf_dir)
    classed = rows.select(F.explode(plate.plate_classes(F.col("pa_codes"))).alias("pa_class"))
    return classed.groupBy("pa_class").agg(F.count(F.lit(1)).alias("appearances"))


def pa_slash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.line_batters(spark, sf_dir)
    slots = F.size(F.filter("pa_codes", lambda s: s.isNotNull() & (s != "")))
    return rows.groupBy("name").agg(
        F.sum(slots).alias("slots"), F.sum(F.size(plate.plate_codes(F.col("pa_codes")))).alias("codes")
    )


def batter_lp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = box.batter_counters(b.line_batters(spark, sf_dir), None)
    scored = rows.withColumn("lp", scoring.batter_lp())
    return tidy(
        scored.select(
            "game_id", "name", "part", "line", "H", "2B", "3B", "HR", "FO", "GO", "LD", "GDP", "SACFLY",
            "SACBUNT", "HBP", "K", "CYCLE", "lp",
        )
    )


def innings_outs(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = b.line_pitchers(spark, sf_dir).select(
        F.lit("first").alias("league"), "inn", innings.outs_from_fraction(F.col("inn")).alias("outs")
    )
    second = b.line_pitchers(spark, sf_dir, second=True).select(
        F.lit("second").alias("league"), "inn", innings.outs_from_decimal(F.col("inn")).alias("outs")
    )
    return first.unionByName(second).groupBy("league", "inn").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("outs").cast("bigint").alias("outs")
    )


def _line_pitcher_rows(spark: SparkSession, sf_dir: str, league: str) -> DataFrame:
    second = league == "mlb"
    rows = b.line_pitchers(spark, sf_dir, second)
    outs = (
        box.team_outs_from_pitchers(rows) if second
        else box.team_outs_from_box(b.line_team_pitching(spark, sf_dir))
    )
    counted = box.pitcher_counters(rows, outs, b.order_games(spark, sf_dir), None, league)
    return counted.withColumn("lp", scoring.pitcher_lp())


def pitcher_lp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _line_pitcher_rows(spark, sf_dir, "kbo")
    return tidy(
        rows.select(
            "game_id", "side", "pos_idx", "name", "role", "OUT", "H", "ER", "HBP", "K", "QS", "QSPLUS",
            "CG", "SHO", "NOHIT", "PERFECT", "HOLD", "SAVE", "BLOWN", "lp",
        )
    )


def pitcher_lp_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _line_pitcher_rows(spark, sf_dir, "mlb")
    return tidy(
        rows.select(
            "game_id", "side", "pos_idx", "name", "role", "OUT", "QS", "QSPLUS", "CG", "SHO", "NOHIT",
            "PERFECT", "lp",
        )
    )


def lp_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.board_rows(spark, sf_dir)
    return rows.groupBy(
        scoring.lp_band(F.col("lp")).alias("board_band"), scoring.lp_band(F.col("lp"), 80).alias("report_band")
    ).agg(F.count(F.lit(1)).alias("rows"))


def special_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = box.special_counts(b.line_records(spark, sf_dir))
    return tidy(
        counts.select("game_id", "name", *[F.col(f"rec_{c}").alias(c) for c in ("E", "WP", "CS", "BK", "PICKOFF", "GRANDSLAM")])
    )


def error_innings(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = box.special_mentions(b.line_records(spark, sf_dir))
    return tidy(mentions.filter(F.col("counter") == "E").groupBy("name", "inn").agg(F.count(F.lit(1)).alias("errors")))


def grand_slam_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = b.line_records(spark, sf_dir).withColumn("game_id", F.concat_ws("-", "game_id", "supp"))
    changed = box.grand_slam_changes(records)
    return changed.select(
        "game_id", "idx", F.concat_ws(",", "old_names").alias("old_names"),
        F.concat_ws(",", "new_names").alias("new_names"),
    )


# --- positions and costs --------------------------------------------------------------------


def _position_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = pos.position_window(
        b.line_batters(spark, sf_dir), b.line_team_pitching(spark, sf_dir), b.order_games(spark, sf_dir),
        WINDOW_END, WINDOW_DAYS,
    )
    return pos.position_table(window)


def auto_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(
        _position_table(spark, sf_dir).select(
            "player_code", "name", "team", "games", "dh_games", "auto_position",
            F.size("innings_by_position").alias("positions"),
        )
    )


def _previous_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return b.table(spark, sf_dir, "customer").select(
        key.cast("string").alias("player_code"), F.concat(F.lit("P"), key.cast("string")).alias("name"),
        b.pick(b.TEAMS, key).alias("team"), F.lit("미상").alias("auto_position"),
        F.when(key % 4 == 0, b.pick(b.BOARD_POSITIONS, key)).alias("manual_position"),
    )


def override_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = pos.merge_overrides(_position_table(spark, sf_dir), _previous_positions(spark, sf_dir))
    return merged.select(
        "player_code", "name", "team", "auto_position",
        F.coalesce("manual_position", F.lit("-")).alias("manual_position"), "effective_position",
    )


def _override_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return b.table(spark, sf_dir, "supplier").select(
        (key * 40).cast("string").alias("player_code"), b.pick(("좌익수", "", DH), key).alias("new_position")
    )


def override_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _previous_positions(spark, sf_dir).withColumn("effective_position", F.col("auto_position"))
    out = pos.apply_overrides(table, _override_requests(spark, sf_dir))
    return out.select(
        "player_code", F.coalesce("manual_position", F.lit("-")).alias("manual_position"), "effective_position"
    )


def override_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _previous_positions(spark, sf_dir)
    return pos.rejected_overrides(table, _override_requests(spark, sf_dir)).select("player_code", "new_position")


def position_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _previous_positions(spark, sf_dir).withColumn(
        "effective_position", F.coalesce(F.nullif(F.col("manual_position"), F.lit("")), F.col("auto_position"))
    )
    rows = pos.attach_position(
        b.line_batters(spark, sf_dir).select("player_code", "part"),
        known.filter(F.col("player_code").cast("bigint") % 3 != 0),
    )
    return tidy(rows.groupBy("position", "position_override").agg(F.count(F.lit(1)).alias("rows")))


def name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pos.find_by_name(_previous_positions(spark, sf_dir), "77").select("player_code", "name", "team")


def cost_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = cost.read_costs(b.cost_list(spark, sf_dir))
    rows = b.cost_rows(spark, sf_dir)
    batters = cost.attach_batter_cost(rows, costs).withColumn("kind", F.lit("batter"))
    pitchers = cost.attach_pitcher_cost(rows, costs).withColumn("kind", F.lit("pitcher"))
    both = batters.unionByName(pitchers)
    return both.groupBy("kind", "name", "team", "position").agg(
        F.count(F.lit(1)).alias("rows"), F.count("roster_cost").alias("matched"),
        F.coalesce(F.sum("roster_cost"), F.lit(0)).cast("bigint").alias("total_cost"),
    )


def cost_match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = cost.read_costs(b.cost_list(spark, sf_dir))
    return cost.match_rate(cost.attach_batter_cost(b.cost_rows(spark, sf_dir), costs), ["position"])


# --- play-by-play ---------------------------------------------------------------------------


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relay.parse_lines(relay.by_chunk(b.relay_events(spark, sf_dir)))


def _starting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relay.starting_lineup(
        b.relay_box_batters(spark, sf_dir), b.relay_box_pitchers(spark, sf_dir), b.relay_events(spark, sf_dir)
    )


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relay.relay_state(relay.with_group_facts(_lines(spark, sf_dir)).drop("text"), _starting(spark, sf_dir))


def _facts(spark: SparkSession, sf_dir: str) -> relay.RelayFacts:
    return relay.relay_facts(b.relay_events(spark, sf_dir), _starting(spark, sf_dir), cut)


def relay_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy("kind", F.coalesce("name", F.lit("")).alias("name")).agg(
        F.count(F.lit(1)).alias("lines")
    )


def relay_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    plays = _lines(spark, sf_dir).filter(F.col("kind") == "play")
    tags = F.explode(F.map_keys(rt.class_tags(F.col("raw_class")))).alias("tag")
    return plays.select("name", tags).groupBy("name", "tag").agg(F.count(F.lit(1)).alias("times"))


def chain_assist(spark: SparkSession, sf_dir: str) -> DataFrame:
    chained = _lines(spark, sf_dir).filter(F.col("chain").isNotNull())
    position = rt.assist_position(F.col("chain"))
    return chained.groupBy(
        "kind", F.concat_ws(">", "chain").alias("chain"), position.alias("assist_position"),
        rt.assist_tag(position).alias("tag"),
    ).agg(F.count(F.lit(1)).alias("lines"))


def group_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = relay.with_group_facts(_lines(spark, sf_dir))
    return tidy(
        facts.select(
            "game_id", "no", "sub", "group_homes", "group_double", "group_triple", "group_out_rose",
            "group_batter_out",
        )
    )


def productive_outs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(relay.productive_outs(_lines(spark, sf_dir)))


def pitcher_in_charge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _state(spark, sf_dir).filter(F.col("kind") != "mark")
    return tidy(rows.select("game_id", "half", "sub", F.coalesce("pitcher", F.lit("-")).alias("pitcher")))


def fielder_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _state(spark, sf_dir).filter(F.col("kind") != "mark")
    at = F.explode(
        F.array(
            *[
                F.struct(F.lit(p).alias("position"), F.coalesce(c, F.lit("-")).alias("fielder"))
                for p, c in relay.DEFENSE.items()
            ]
        )
    ).alias("a")
    return rows.select("game_id", "half", at).groupBy("game_id", "half", "a.position", "a.fielder").agg(
        F.count(F.lit(1)).alias("lines")
    )


def prev_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _state(spark, sf_dir).filter(F.col("from_base").isNotNull())
    return tidy(rows.select("game_id", "half", "sub", "name", "from_base", "slot"))


def inherited_runners(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = b.relay_events(spark, sf_dir)
    credits = relay.inherited_runners(cut(_state(spark, sf_dir)), relay.final_states(events))
    return tidy(
        credits.groupBy("game_id", "name", "tag", "inn", "text").agg(
            F.count(F.lit(1)).alias("runners"), F.sum("points").alias("points")
        )
    )


def earned_run_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(relay.earned_candidates(cut(_state(spark, sf_dir))).select("game_id", "name", "sub", "inn", "runner"))


def entry_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(relay.entry_margins(_state(spark, sf_dir)))


def final_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(relay.final_states(b.relay_events(spark, sf_dir)))


def line_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relay.line_credits(_state(spark, sf_dir))
    return tidy(
        rows.select(
            "game_id", "name", "role", "sub", "inn", "text", "tag", "n", "points",
            F.coalesce("pos", F.lit("")).alias("pos"),
        )
    )


def _scored(spark: SparkSession, sf_dir: str, facts: relay.RelayFacts) -> tuple[DataFrame, DataFrame]:
    games = b.relay_games(spark, sf_dir)
    specials = box.special_counts(b.relay_records(spark, sf_dir))
    batters = box.batter_counters(b.relay_box_batters(spark, sf_dir), specials, counted=True)
    batters = box.attach_game(batters, games)
    position = b.pick(b.BOARD_POSITIONS, F.col("pos_idx") + F.length("game_id"))
    batters = batters.withColumns({"position": position, "position_override": F.lit(False)})
    pitchers_box = b.relay_box_pitchers(spark, sf_dir)
    team = pitchers_box.groupBy("game_id", "side").agg(F.max("inn").alias("inn"))
    pitchers = box.pitcher_counters(pitchers_box, box.team_outs_from_box(team), games, specials, "kbo")
    pitchers = box.attach_game(pitchers, games)
    return merge.merge_batters(batters, facts), merge.merge_pitchers(pitchers, facts)


def scored_batters(spark: SparkSession, sf_dir: str) -> DataFrame:
    batters, _ = _scored(spark, sf_dir, _facts(spark, sf_dir))
    return tidy(batters.select("game_id", "side", "name", "team", *BATTER_COUNTERS, "ambiguous", "lp"))


def scored_pitchers(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, pitchers = _scored(spark, sf_dir, _facts(spark, sf_dir))
    return tidy(pitchers.select("game_id", "side", "name", "team", "role", *PITCHER_COUNTERS, "lp"))


def er_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _facts(spark, sf_dir)
    _, pitchers = _scored(spark, sf_dir, facts)
    rows = merge.earned_lines(facts.earned, pitchers)
    return tidy(rows.select("game_id", "name", "ord", "inn", "text", "points"))


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _facts(spark, sf_dir)
    batters, pitchers = (cut(x) for x in _scored(spark, sf_dir, facts))
    mentions = box.special_mentions(b.relay_records(spark, sf_dir))
    return merge.play_ledger(batters, pitchers, facts, mentions, cut)


def play_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ledger(spark, sf_dir)
    return tidy(
        rows.select(
            "game_id", "name", "role", F.coalesce("inn", F.lit(0)).alias("inn"), "text", "tag", "n", "points"
        )
    )


def inning_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merge.inning_totals(_ledger(spark, sf_dir))
    return tidy(
        rows.select("game_id", "name", "role", F.coalesce("inn", F.lit(0)).alias("inn"), "points", "lines")
    )


def ledger_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped = merge.cap_once(relay.line_credits(_state(spark, sf_dir)))
    tags = ("DP_FIELD", "TP_FIELD")
    return tidy(
        capped.filter(F.col("tag").isin(*tags)).select("game_id", "name", "tag", "sub", "text", "points")
    )


def position_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merge.position_events(relay.line_credits(_state(spark, sf_dir)))
    return rows.groupBy("game_id", "name", "tag", "pos").agg(F.count(F.lit(1)).alias("events"))


def field_rule_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _facts(spark, sf_dir)
    batters, _ = _scored(spark, sf_dir, facts)
    rows = merge.rescore_modes(batters, merge.position_events(facts.credits))
    return tidy(rows.select("game_id", "name", "mode", "dh", *FIELD_COUNTERS, "lp"))


def category_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    batters, pitchers = _scored(spark, sf_dir, _facts(spark, sf_dir))
    keep = ["game_id", "name", "role"]
    b_items = boards.batter_category_items(batters.withColumn("role", F.lit("타자")), keep)
    p_items = boards.pitcher_category_items(pitchers, keep)
    return boards.category_totals(b_items.unionByName(p_items), keep)


def visible_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = box.batter_counters(b.line_batters(spark, sf_dir), None)
    items = boards.visible_items(boards.batter_category_items(rows, ["name"]))
    return items.groupBy("name", "category", "label").agg(
        F.sum("count").cast("bigint").alias("times"), F.sum("points").cast("bigint").alias("points")
    )


# --- second league --------------------------------------------------------------------------


def _second_counts(spark: SparkSession, sf_dir: str) -> tuple[sl.OutcomeCounts, DataFrame]:
    batters = b.relay_box_batters(spark, sf_dir).withColumns(
        {"pos": F.coalesce(plate.position_of_char(F.col("pos")), F.lit(DH)), "hbp": F.col("pa_HBP")}
    )
    starters = b.relay_box_pitchers(spark, sf_dir).filter(F.col("pos_idx") == 0).select(
        "game_id", F.when(F.col("side") == "home", "0").otherwise("1").alias("half"),
        F.col("name").alias("pitcher"),
    )
    counts = sl.outcome_counts(b.relay_events(spark, sf_dir), starters, sl.starting_fielders(batters), cut)
    return counts, batters


def second_league_batters(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, batters = _second_counts(spark, sf_dir)
    rows = sl.merge_batters(sl.batter_counters(batters), counts)
    return tidy(
        rows.select("game_id", "name", "H", "2B", "3B", "HR", "GDP", "SACFLY", "SACBUNT", "CS", "PICKOFF",
                    "GRANDSLAM", "E", "HBP", "CYCLE", "lp")
    )


def second_league_pitchers(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, _ = _second_counts(spark, sf_dir)
    return tidy(counts.pitchers)


def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = b.table(spark, sf_dir, "documents").select(
        F.col("source").alias("game_id"), F.col("doc_id").alias("no"), F.lit(1).alias("inn"),
        F.lit("0").alias("half"), F.replace("text", F.lit("\n"), F.lit("<br/>")).alias("text"),
    )
    lines = landed.split_lines(groups)
    return tidy(lines.select("no", "sub", F.length("text").alias("chars")))


# --- boards ---------------------------------------------------------------------------------


def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.board_rows(spark, sf_dir)
    ranked = boards.leaderboard(rows, ["game_date", "kind"], ["row_id"], F.expr("row_id div 1000000"))
    return tidy(ranked.select("game_date", "kind", "rank", "row_id", "name", "lp"))


def kth_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(boards.thresholds(b.board_rows(spark, sf_dir)))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boards.player_history(b.board_rows(spark, sf_dir))


def player_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _history(spark, sf_dir)
    return tidy(
        rows.select(
            "game_date", "name", "team", "lp", "pool", "threshold", "relative_value",
            F.round(F.coalesce("cost_value", F.lit(-1.0)), 6).alias("cost_value"),
            F.round("shown", 6).alias("shown"),
        )
    )


def history_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boards.history_scale(_history(spark, sf_dir), ["name", "team"])
    return rows.select("name", "team", F.round("scale", 6).alias("scale"))


def daily_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.board_rows(spark, sf_dir)
    tiles = boards.day_tiles(rows.filter(F.col("kind") == "batter"), rows.filter(F.col("kind") == "pitcher"))
    return tidy(tiles)


def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = b.table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("team"), F.lit("").alias("position")
    )
    return boards.filter_batters(people, "  HOUSE ").select("name", "team")


def position_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.board_rows(spark, sf_dir)
    first = boards.filter_batters(rows, "c1", "좌익수").select(F.lit("first").alias("league"), "row_id", "position")
    second = boards.filter_batters(rows, "c1", "외야수", merge_outfield=True).select(
        F.lit("second").alias("league"), "row_id", "position"
    )
    return first.unionByName(second)


def role_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(boards.filter_pitchers(b.board_rows(spark, sf_dir), "kia", RELIEVER).select("row_id", "name", "lp"))


def month_and_cost_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.board_rows(spark, sf_dir)
    kept = rows.filter(
        F.col("roster_cost").isNotNull() & (rules.month_of(F.col("game_date")) == "1999-05")
    )
    return tidy(kept.select("game_date", "row_id", "roster_cost"))


def hidden_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _line_pitcher_rows(spark, sf_dir, "kbo").filter(F.col("role") == STARTER)
    hidden = boards.hidden_pitcher_columns(STARTER)
    return tidy(boards.flat_board(rows, boards.BOARD_PITCHER_COLUMNS, hidden, ["game_id", "side"]))


def group_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = box.batter_counters(b.line_batters(spark, sf_dir), None)
    board = boards.batter_group_board(rows, "좌익수", ["name"])
    groups = [c for c in board.columns if c != "name"]
    return board.groupBy("name").agg(*[F.sum(c).cast("bigint").alias(c) for c in groups])


def _named_batters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = box.batter_counters(b.line_batters(spark, sf_dir), None)
    named = box.attach_game(rows, b.order_games(spark, sf_dir))
    position = F.coalesce(plate.position_of_char(F.substring("pos", 1, 1)), F.lit(""))
    return named.withColumns({"position": position, "lp": scoring.batter_lp()})


def batter_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = boards.leaderboard(
        _named_batters(spark, sf_dir), ["game_date"], ["game_id", "part", "line", "name"], F.col("part").bitwiseAND(255)
    )
    return tidy(boards.export(ranked, boards.BATTER_EXPORT).drop("stadium"))


def pitcher_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = box.attach_game(_line_pitcher_rows(spark, sf_dir, "kbo"), b.order_games(spark, sf_dir))
    totals = rows.groupBy("game_date", "team", "opponent", "role").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("lp").cast("bigint").alias("lp"), F.max("lp").alias("best")
    )
    return tidy(totals)


def pitcher_ranked_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pitchers of each day in the order and columns of the export."""
    rows = box.attach_game(_line_pitcher_rows(spark, sf_dir, "kbo"), b.order_games(spark, sf_dir))
    ranked = boards.leaderboard(rows, ["game_date"], ["game_id", "side", "pos_idx", "name", "inn"], F.substring("game_id", -2, 2).cast("bigint"))
    return tidy(boards.export(ranked, boards.PITCHER_EXPORT).drop("stadium"))


def category_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category totals by player, by team and by day."""
    pitchers = box.attach_game(_line_pitcher_rows(spark, sf_dir, "kbo"), b.order_games(spark, sf_dir))
    return boards.category_cube(_named_batters(spark, sf_dir), pitchers, ["name", "team", "game_date"])


def date_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(sinks.date_index(_named_batters(spark, sf_dir)))


def date_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("game_date")
    rows = b.order_games(spark, sf_dir).groupBy("game_date").agg(F.count(F.lit(1)).alias("games"))
    compact = rules.compact_date(F.date_format(day, "yyyyMMdd"))
    return tidy(
        rows.select(
            "game_date", "games", rules.date_label(compact).alias("label"), rules.month_of(day).alias("month"),
            F.dayofmonth(F.last_day(day)).alias("days_in_month"),
        )
    )


def date_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.board_rows(spark, sf_dir)
    latest = boards.latest_date(rows).select(F.year("latest").alias("year"), F.lit("latest").alias("fact"))
    years = boards.distinct_years(rows).withColumn("fact", F.lit("year"))
    return tidy(latest.unionByName(years))


# --- rosters --------------------------------------------------------------------------------


def roster_feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = roster.feasibility(roster.candidates(*b.roster_pool(spark, sf_dir)))
    return tidy(out.select("day", "feasible", F.coalesce("reason", F.lit("")).alias("reason")))


def optimal_roster_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = roster.candidates(*b.roster_pool(spark, sf_dir))
    return tidy(roster.best_rosters(pool, (25, 40)).drop("roster"))


def optimal_roster_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The picked players add up, are distinct, and fill the slots."""
    pool = roster.candidates(*b.roster_pool(spark, sf_dir))
    picks = roster.roster_rows(roster.best_rosters(pool, (40,)))
    return tidy(
        picks.groupBy("day").agg(
            F.sum("lp").alias("total_lp"), F.sum("cost").alias("total_cost"),
            F.count_distinct("player").alias("players"), F.count_distinct("slot").alias("slots"),
        )
    )


# --- schedule -------------------------------------------------------------------------------


def _calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.build_calendar(b.order_games(spark, sf_dir))


def calendar_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _calendar(spark, sf_dir)
    return tidy(
        rows.select(
            "game_date", F.coalesce("round", F.lit("-")).alias("round"), "games"
        )
    )


def calendar_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = schedule.round_summary(_calendar(spark, sf_dir))
    return tidy(rows.withColumn("round", F.coalesce("round", F.lit("-"))))


def _done_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "A").groupBy(
        F.to_date("l_shipdate").alias("game_date")
    ).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 5).select("game_date")


def todo_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = schedule.season_days(_calendar(spark, sf_dir))
    return tidy(schedule.todo(targets, _done_days(spark, sf_dir)).select("game_date", "round"))


def games_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    games = b.order_games(spark, sf_dir)
    official = schedule.build_calendar(games).filter(F.col("round").isin("kbo_e", "kbo_r"))
    listed = schedule.calendar_games(games).join(official, "game_date", "left_semi")
    return tidy(schedule.games_of_days(games.select("game_date"), listed, games))


def active_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(schedule.active_window(b.order_games(spark, sf_dir), F.to_timestamp(F.lit(NOW))))


def status_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    games = b.order_games(spark, sf_dir)
    parts = [
        ("live", box.live_games(games)), ("finished", box.finished(games)), ("held", box.not_cancelled(games)),
        ("pregame", pregame.pregame_games(games, F.to_timestamp(F.lit(NOW)))),
    ]
    out = None
    for name, rows in parts:
        counted = rows.groupBy("status_code").agg(F.count(F.lit(1)).alias("games")).withColumn("gate", F.lit(name))
        out = counted if out is None else out.unionByName(counted)
    return out


def _pregame(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return pregame.pregame_rows(
        b.order_games(spark, sf_dir), b.active_roster(spark, sf_dir), b.announced(spark, sf_dir),
        b.known_positions(spark, sf_dir), F.to_timestamp(F.lit(NOW)),
    )


def pregame_batters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _pregame(spark, sf_dir)
    return tidy(rows.select("game_id", "side", "name", "team", "position", "is_starter", "show_order", "lp", "K"))


def pregame_pitchers(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = _pregame(spark, sf_dir)
    return tidy(rows.select("game_id", "side", "name", "team", "role", "is_starter", "show_order", "QS"))


def roster_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(tables.roster_from_pages(b.roster_pages(spark, sf_dir)))


# --- live days ------------------------------------------------------------------------------


def live_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream lines of the events table in, some late, some wrong at first; every day touched is recomputed whole and replaced.

    The second delivery touches every fifth day: its late lines, the right texts of lines that came wrong, and old wrong
    ones once more.
    """
    work = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
    mart, landing = f"{work}/mart", f"{work}/landing"
    event, fifth = F.col("event_id"), F.day("game_date") % 5 == 0
    sent = b.relay_events(spark, sf_dir, extra=["event_id", F.to_date("ts").alias("game_date")])
    sent = sent.withColumn("game_id", F.concat_ws("/", "game_date", "game_id"))
    wrong, late = fifth & (event % 13 == 0), fifth & (event % 11 == 0)

    def at(hour: int, part: int, right: bool = True):
        text = F.col("text") if right else F.lit("1구 볼")
        return F.struct(F.to_timestamp(F.lit(f"2026-05-05 {hour:02}:00:00")).alias("ingested_at"), F.lit(part).alias("part"), text.alias("said"))

    versions = F.when(wrong, F.array(at(9, 0, False), at(10, 1), at(8, 1, False))).when(late, F.array(at(9, 1))).otherwise(F.array(at(9, 0)))
    sent = sent.withColumn("v", F.explode(versions)).drop("event_id").withColumn("text", F.col("v.said"))
    sent = sent.select("*", "v.ingested_at", "v.part").drop("v")
    def recompute(session: SparkSession, days: list[str], lines: DataFrame) -> None:
        state = relay.relay_state(
            relay.with_group_facts(relay.parse_lines(relay.by_chunk(lines.drop("ingested_at", "game_date")))).drop("text")
        )
        credits = relay.line_credits(state)
        totals = credits.groupBy("game_id", "name", "role").agg(F.sum("points").alias("points"))
        totals.withColumn("game_date", F.to_date(F.substring_index("game_id", "/", 1))).write.mode(
            "overwrite"
        ).option("partitionOverwriteMode", "dynamic").partitionBy("game_date").parquet(mart)

    for part in (0, 1):
        delivery = sent.where(F.col("part") == part).drop("part").repartition(F.xxhash64("no", "sub", "ingested_at"))
        delivery.write.parquet(f"{landing}/part={part}")
        stream = spark.readStream.schema(sent.schema).parquet(landing).drop("part")
        linestore.follow(stream, f"{work}/store", recompute, f"{work}/offsets", available_now=True).awaitTermination()
    out = spark.read.schema(
        "game_id STRING, name STRING, role STRING, points BIGINT, game_date DATE"
    ).parquet(mart)
    return tidy(out)


ALL: dict[str, Query] = {
    f.__name__: f
    for f in (
        pa_class_counts, pa_slash_split, batter_lp, innings_outs, pitcher_lp, pitcher_lp_second, lp_bands,
        special_records, error_innings, grand_slam_diff,
        auto_position, override_merge, override_upsert, override_rejects, position_attach, name_lookup,
        cost_lookup, cost_match_rate,
        relay_kinds, relay_tags, chain_assist, group_facts, productive_outs, pitcher_in_charge, fielder_asof,
        prev_base, inherited_runners, earned_run_origin, entry_margins, final_score, line_credits,
        scored_batters, scored_pitchers, er_cut, play_ledger, inning_totals, ledger_cap, position_events,
        field_rule_modes, category_totals, visible_items,
        second_league_batters, second_league_pitchers, split_lines,
        leaderboard, kth_threshold, player_history, history_scale, daily_tiles, text_search, position_filter,
        role_filter, month_and_cost_filter, hidden_columns, group_board, date_facts,
        batter_export, pitcher_export, pitcher_ranked_export, category_cube, date_index, date_labels,
        roster_feasibility, optimal_roster_value, optimal_roster_check,
        calendar_days, calendar_rounds, todo_dates, games_of_days, active_window, status_gate,
        pregame_batters, pregame_pitchers, roster_pages, live_refresh,
    )
}
