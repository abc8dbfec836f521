"""Play-by-play attribution: who gets credit for each line of a game.

The per-game state (pitcher in charge, fielder at each position, bases before the line, inherited
runners, who put a runner on) is expressed with :func:`dugout.operators.scan.scan`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from dugout.functions import relaytext as rt
from dugout.model import (
    BATTER_WEIGHTS as BW, CATCHER, FIELD_POSITIONS, OUTFIELD, PITCHER, PITCHER_WEIGHTS as PW,
)
from dugout.operators.scan import scan

GROUPS_PER_CHUNK = 16384  # plate appearances per chunk; a normal game has fewer than 150
END_OF_GAME = 2**31 - 1
EMPTY = "0"
DEFENSE = {position: f"at_{i}" for i, position in enumerate(FIELD_POSITIONS)}
CREDIT_COLUMNS = (
    "game_id", "name", "role", "no", "sub", "ord", "inn", "text", "tag", "n", "points", "pos",
)


@dataclass
class RelayFacts:
    """Everything the merge step needs from one pass over the relay."""

    credits: DataFrame   # ledger lines
    earned: DataFrame    # earned-run candidates
    margins: DataFrame   # score margin when a reliever came in
    finals: DataFrame    # last inning and score of each game
    advances: DataFrame  # productive outs per batter


def by_chunk(events: DataFrame, groups_per_chunk: int = GROUPS_PER_CHUNK) -> DataFrame:
    """Lines placed by game and chunk: the one placement everything below keeps.

    The raw lines move, which are smaller than the parsed ones; parsing follows the shuffle. The number of parts is
    given, as adaptive execution would merge parts by the size of the raw lines, and a task would hold very many parsed ones.
    """
    chunk = F.floor(F.col("no") / groups_per_chunk).cast("int")
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return events.withColumn("chunk", chunk).repartition(parts, "game_id", "chunk")


def parse_lines(events: DataFrame) -> DataFrame:
    """Kind, names, outcome class and chain of every line."""
    text = F.col("text")
    kind = F.col("kind")
    play_line = text.rlike(rt.PLAY)
    return (
        events.withColumn("kind", rt.line_kind(text))
        .withColumns(
            {
                "play_desc": F.when(play_line, F.regexp_extract(text, rt.PLAY, 2)),
                "play_name": F.when(play_line, F.regexp_extract(text, rt.PLAY, 1)),
            }
        )
        .withColumns(
            {
                "name": rt.line_name(text, kind),
                "label": rt.line_label(text, kind),
                "from_base": rt.run_base(text, kind),
                "by_pitcher": (kind == "pickoff") & (F.regexp_extract(text, rt.PICKOFF, 2) == PITCHER),
                "raw_class": rt.play_class(F.col("play_desc")),
                "raw_bunt_out": F.coalesce(rt.is_bunt_out(F.col("play_desc")), F.lit(False)),
                "chain": F.when(kind == "play", rt.play_chain(F.col("play_desc"))).when(
                    kind == "runner_out", rt.runner_out_chain(text)
                ),
                "home_line": rt.is_plain_home(text),
                "advance_line": rt.is_unmarked_advance(text),
                "double_line": text.contains("병살"),
                "triple_line": text.contains("삼중살"),
            }
        )
    )


def with_group_facts(lines: DataFrame) -> DataFrame:
    """Facts about the plate appearance a line belongs to."""
    group = (
        Window.partitionBy("game_id", "chunk", "no").orderBy("sub")
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    first_out = F.when(
        F.col("play_desc").isNotNull(),
        F.col("raw_bunt_out")
        | rt.has_tag(F.col("raw_class"), "GO") | rt.has_tag(F.col("raw_class"), "FO")
        | rt.has_tag(F.col("raw_class"), "K"),
    )
    return lines.withColumns(
        {
            "group_homes": F.sum(F.col("home_line").cast("int")).over(group),
            "group_double": F.max("double_line").over(group),
            "group_triple": F.max("triple_line").over(group),
            "group_out_rose": F.coalesce(F.max("out").over(group) > F.min("out").over(group), F.lit(False)),
            "group_batter_out": F.coalesce(F.first(first_out, ignorenulls=True).over(group), F.lit(False)),
        }
    )


def productive_outs(lines: DataFrame) -> DataFrame:
    """One credit per appearance whose out moved another runner with nothing else to explain it."""
    productive = F.coalesce(rt.is_productive_out(F.col("play_desc")), F.lit(False))
    per_group = lines.groupBy("game_id", "chunk", "no").agg(
        F.min_by("play_name", F.when(productive, F.col("sub"))).alias("name"),
        F.max("advance_line").alias("advanced"),
    )
    return (
        per_group.filter(F.col("name").isNotNull() & F.col("advanced"))
        .groupBy("game_id", "name")
        .agg(F.count(F.lit(1)).cast("int").alias("advance"))
    )


def relay_state(lines: DataFrame, starting: DataFrame | None = None) -> DataFrame:
    """Lines with the pitcher and fielders in charge, the bases before the line and the epoch.

    ``starting`` has (game_id, half, pitcher, defense MAP<position, name>). An inning mark resets
    both halves, so it is repeated for each; a line keeps its own half.
    """
    mark = F.col("kind") == "mark"
    halves = F.when(mark, F.array(F.lit("0"), F.lit("1"))).otherwise(F.array(F.col("half")))
    rows = lines.withColumn("own_half", F.col("half")).withColumn("half", F.explode(halves))

    def incoming(position: str) -> Column:
        return F.when((F.col("kind") == "sub") & (F.col("label") == position), F.col("name"))

    fills = {"pitcher": (incoming(PITCHER), True)}
    fills |= {column: (incoming(position), True) for position, column in DEFENSE.items()}
    empty = F.array(*[F.lit(EMPTY)] * 3)
    fills["prev_base"] = (F.when(mark, empty).otherwise(F.col("base")), False)
    initial = None
    if starting is not None:
        initial = starting.select(
            "game_id", "half", "pitcher",
            *[F.col("defense").getItem(p).alias(c) for p, c in DEFENSE.items()],
        )
    return scan(
        rows, ["game_id", "half"], ["no", "sub"], "chunk", fills,
        {"epoch": (mark.cast("int"), True)}, initial, fold="half",
    ).withColumns(
        {
            "slot": F.when(
                F.col("from_base").isNotNull(),
                F.get(F.coalesce("prev_base", empty), F.col("from_base") - 1),
            ),
            "play": F.when(
                (F.col("kind") == "play")
                & rt.has_tag(F.col("raw_class"), "GO")
                & F.col("play_desc").contains("출루")
                & ~F.col("group_out_rose"),
                rt.NO_CLASS,
            ).when(F.col("kind") == "play", F.col("raw_class")),
        }
    )


def fielder_at(position: Column) -> Column:
    out = None
    for name, column in DEFENSE.items():
        out = F.when(position == name, F.col(column)) if out is None else out.when(
            position == name, F.col(column)
        )
    return out


def _line(
    name: Column, role: str, text: Column | str, tag: Column | str, points: Column | int,
    when: Column | None = None, n: Column | int = 1, pos: Column | None = None,
) -> Column:
    """One ledger line, or NULL where it does not apply or nobody is named."""
    def column(value, kind):
        return (value if isinstance(value, Column) else F.lit(value)).cast(kind)

    line = F.struct(
        name.cast("string").alias("name"), F.lit(role).alias("role"), column(text, "string").alias("text"),
        column(tag, "string").alias("tag"), column(n, "int").alias("n"),
        column(points, "int").alias("points"),
        (pos if pos is not None else F.lit(None)).cast("string").alias("pos"),
    )
    # Most lines of an event do not apply; those are not spelled out.
    return F.when(name.isNotNull() if when is None else when & name.isNotNull(), line)


def _named(before: str, who: Column, after: str) -> Column:
    return F.concat(F.lit(before), who, F.lit(after))


def _part_lines(detail: Column, double: Column, triple: Column) -> Column:
    """Double- and triple-play shares of every fielder in the chain."""
    shares = F.transform(
        F.coalesce(F.col("chain"), F.array().cast("array<string>")),
        lambda p: F.array(
            _line(fielder_at(p), "bat", F.concat(F.lit("병살 가담 ("), p, F.lit(", "), detail, F.lit(")")),
                  "DP_FIELD", BW["DP_FIELD"], double, pos=p),
            _line(fielder_at(p), "bat", F.concat(F.lit("삼중살 가담 ("), p, F.lit(", "), detail, F.lit(")")),
                  "TP_FIELD", BW["TP_FIELD"], triple, pos=p),
        ),
    )
    return F.flatten(shares)


def _assist_line(detail: Column, when: Column) -> Column:
    position = rt.assist_position(F.col("chain"))
    points = F.when(position.isin(*OUTFIELD), BW["OF_ASSIST"]).otherwise(BW["ASSIST"])
    return _line(
        fielder_at(position), "bat",
        F.concat(F.lit("보살 ("), position, F.lit(", "), detail, F.lit(")")),
        rt.assist_tag(position), points, when, pos=position,
    )


def _steal_lines() -> Column:
    runner, catcher = F.col("name"), F.col(DEFENSE[CATCHER])
    allowed = _named("도루 허용 (", runner, ")")
    return F.array(
        _line(runner, "bat", "도루 성공", "SB", BW["SB"]),
        _line(catcher, "bat", allowed, "SB_ALLOWED_CATCHER", BW["SB_ALLOWED_CATCHER"], pos=F.lit(CATCHER)),
        _line(F.col("pitcher"), "pitch", allowed, "SB_ALLOWED", PW["SB_ALLOWED"]),
        _line(runner, "bat", "득점", "R", BW["R"], F.col("from_base").isNotNull()),
    )


def _caught_lines() -> Column:
    runner, catcher, pitcher = F.col("name"), F.col(DEFENSE[CATCHER]), F.col("pitcher")
    stopped = _named("도루 저지 (", runner, ")")
    return F.array(
        _line(runner, "bat", "도루 실패(아웃)", "CS", BW["CS"]),
        _line(catcher, "bat", stopped, "CS_CATCHER", BW["CS_CATCHER"], pos=F.lit(CATCHER)),
        _line(pitcher, "pitch", stopped, "CS_A", PW["CS_A"]),
        _line(pitcher, "pitch", _named("아웃카운트 1개 (", runner, " 도루 저지)"), "OUT", PW["OUT"]),
    )


def _pickoff_lines() -> Column:
    runner, pitcher = F.col("name"), F.col("pitcher")
    return F.array(
        _line(runner, "bat", "견제사(아웃)", "PICKOFF", BW["PICKOFF"]),
        _line(pitcher, "pitch", _named("아웃카운트 1개 (", runner, " 견제사)"), "OUT", PW["OUT"]),
        _line(pitcher, "pitch", _named("견제사 (", runner, ")"), "PICKOFF_A", PW["PICKOFF_A"],
              F.col("by_pitcher")),
    )


def _runner_out_lines() -> Column:
    detail = F.lit("주자 아웃")
    special = F.col("group_double") | F.col("group_triple")
    plain = F.col("chain").isNotNull() & ~special
    shares = F.when(special, _part_lines(detail, F.col("group_double"), F.col("group_triple")))
    simple = F.array(
        _assist_line(detail, plain),
        _line(F.col("pitcher"), "pitch", "아웃카운트 1개 (주자 아웃)", "OUT", PW["OUT"],
              plain & ~F.col("group_batter_out")),
    )
    return F.when(special, shares).otherwise(simple)


def _play_lines() -> Column:
    batter, pitcher, desc, play = F.col("name"), F.col("pitcher"), F.col("play_desc"), F.col("play")
    bunt = F.col("raw_bunt_out")
    scored = ~bunt & (play != rt.NO_CLASS)
    homes = F.col("group_homes")
    triple, double = desc.contains("삼중살"), desc.contains("병살")
    rbi = F.when(bunt, homes).when(
        scored,
        F.when((play == "GDP") | triple, 0).otherwise(homes) + F.when(play == "HR", 1).otherwise(0),
    ).otherwise(0)
    is_two = desc.contains("2루타")
    is_three = ~is_two & desc.contains("3루타")
    outs = F.when(bunt, 1).when(
        scored,
        F.when(play == "GDP", 2).when(play.isin("K", "SACFLY", "FO", "SACBUNT", "GO", "LD"), 1).otherwise(0),
    ).otherwise(0)

    def against(text: str, tag: str, when: Column) -> Column:
        return _line(pitcher, "pitch", _named(f"{text} (", batter, ")"), tag, PW[tag], when)

    single = F.array(
        against("피2루타", "2B_A", is_two),
        against("피3루타", "3B_A", is_three),
        _line(batter, "bat", desc, F.when(bunt, "PLAY:BUNT_OUT").otherwise(F.concat(F.lit("PLAY:"), play)),
              F.when(bunt, 0).otherwise(rt.class_points(play, BW)), bunt | scored),
        _line(batter, "bat", "득점 (홈런)", "R", BW["R"], scored & (play == "HR")),
        _line(batter, "bat", F.concat(F.lit("타점 "), rbi.cast("string"), F.lit("개")), "RBI",
              rbi * BW["RBI"], rbi > 0, n=rbi),
        against("피안타", "H", scored & rt.has_tag(play, "H")),
        against("피홈런", "HR", scored & (play == "HR")),
        against("볼넷 허용", "BB", scored & (play == "BB")),
        against("사구 허용", "HBP", scored & (play == "HBP")),
        against("탈삼진", "K", scored & (play == "K")),
        _line(pitcher, "pitch",
              F.concat(F.lit("아웃카운트 "), outs.cast("string"), F.lit("개 ("), batter, F.lit(")")),
              "OUT", outs * PW["OUT"], outs > 0, n=outs),
        _assist_line(
            F.concat(batter, F.lit(" 타석")),
            F.col("chain").isNotNull() & ~double & ~triple
            & (rt.has_tag(play, "FO") | rt.has_tag(play, "GO")),
        ),
    )
    return F.concat(single, _part_lines(F.concat(batter, F.lit(" 타석")), double, triple))


def line_credits(state: DataFrame) -> DataFrame:
    """Ledger lines that follow from the line itself and the state at that moment."""
    kind = F.col("kind")
    entries = (
        F.when(kind == "play", _play_lines())
        .when(kind == "steal", _steal_lines())
        .when(kind == "run", F.array(_line(F.col("name"), "bat", "득점", "R", BW["R"])))
        .when(kind == "caught", _caught_lines())
        .when(kind == "pickoff", _pickoff_lines())
        .when(kind == "runner_out", _runner_out_lines())
    )
    return (
        state.filter(kind.isin("play", "steal", "run", "caught", "pickoff", "runner_out"))
        .select(
            "game_id", "no", "sub", "inn",
            F.posexplode(F.filter(entries, lambda e: e.isNotNull())).alias("ord", "e"),
        )
        .select("game_id", "no", "sub", "inn", "ord", "e.*")
        .select(*CREDIT_COLUMNS)
    )


def final_states(events: DataFrame) -> DataFrame:
    """Inning and score of the last line of each game."""
    return events.groupBy("game_id").agg(
        F.max_by(
            F.struct(F.col("inn").alias("last_inn"), "home_score", "away_score"), F.struct("no", "sub")
        ).alias("s")
    ).select("game_id", "s.*")


def inherited_runners(state: DataFrame, finals: DataFrame) -> DataFrame:
    """Runners a reliever took over: scored on, or left on base."""
    place = ["game_id", "half", "epoch", "slot"]
    taken = state.filter((F.col("kind") == "sub") & (F.col("label") == PITCHER)).select(
        "game_id", "half", "epoch", "chunk", "no", "sub", "inn",
        F.lit(None).cast("string").alias("runner"), F.col("name").alias("taken_by"),
        F.explode(F.array_distinct("base")).alias("slot"),
    )
    runs = state.filter(F.col("from_base").isNotNull()).select(
        "game_id", "half", "epoch", "chunk", "no", "sub", "inn",
        F.col("name").alias("runner"), F.lit(None).cast("string").alias("taken_by"), "slot",
    )
    moves = taken.unionByName(runs).filter(F.col("slot") != EMPTY)
    spans = scan(
        moves, place, ["no", "sub"], "chunk",
        totals={"span": (F.col("runner").isNotNull().cast("int"), False)},
    )
    settled = spans.groupBy(*place, "span").agg(
        F.min_by("taken_by", F.when(F.col("taken_by").isNotNull(), F.struct("no", "sub"))).alias("name"),
        F.min(F.when(F.col("runner").isNotNull(), F.struct("no", "sub", "inn", "runner"))).alias("run"),
    ).filter(F.col("name").isNotNull())
    scored = settled.filter(F.col("run").isNotNull()).select(
        "game_id", "name", F.lit("pitch").alias("role"), "run.no", "run.sub", F.lit(-1).alias("ord"),
        "run.inn", F.concat(F.lit("승계주자 "), F.col("run.runner"), F.lit(" 실점 허용")).alias("text"),
        F.lit("INHERITED_SCORED").alias("tag"), F.lit(1).alias("n"),
        F.lit(PW["INHERITED_SCORED"]).alias("points"), F.lit(None).cast("string").alias("pos"),
    )
    marks = state.filter((F.col("kind") == "mark") & (F.col("half") == "0")).select(
        "game_id", F.col("epoch").alias("mark_epoch"), F.col("no").alias("mark_no"),
        F.col("sub").alias("mark_sub"), F.col("inn").alias("mark_inn"),
    )
    left = (
        settled.filter(F.col("run").isNull())
        .withColumn("mark_epoch", F.col("epoch") + 1)
        .join(marks, ["game_id", "mark_epoch"], "left")
        .join(finals.select("game_id", "last_inn"), "game_id", "left")
    )
    ended = F.col("mark_no").isNull()
    stranded = left.select(
        "game_id", "name", F.lit("pitch").alias("role"),
        F.coalesce("mark_no", F.lit(END_OF_GAME)).alias("no"),
        F.coalesce("mark_sub", F.lit(0)).alias("sub"), F.lit(-1).alias("ord"),
        F.when(ended, F.col("last_inn")).otherwise(F.col("mark_inn")).alias("inn"),
        F.when(ended, "승계주자 실점 막음(경기 종료)").otherwise("승계주자 실점 막음").alias("text"),
        F.lit("INHERITED_STRANDED").alias("tag"), F.lit(1).alias("n"),
        F.lit(PW["INHERITED_STRANDED"]).alias("points"), F.lit(None).cast("string").alias("pos"),
    )
    return scored.unionByName(stranded).select(*CREDIT_COLUMNS)


def earned_candidates(state: DataFrame) -> DataFrame:
    """Runs, with the pitcher who put the runner on base. A home run is its own origin."""
    scored = (F.col("kind") == "play") & ~F.col("raw_bunt_out") & F.col("pitcher").isNotNull()
    reached = scored & F.col("play").isin("1B", "2B", "3B", "BB", "HBP")
    ran = F.col("from_base").isNotNull()
    moves = state.filter(reached | ran).select(
        "game_id", F.col("name").alias("runner"), "chunk", "no", "sub", "inn", ran.alias("ran"),
        F.when(ran, F.lit("")).otherwise(F.col("pitcher")).alias("owner"),
    )
    traced = scan(
        moves, ["game_id", "runner"], ["no", "sub"], "chunk", {"name": (F.col("owner"), False)}
    ).filter(F.col("ran") & (F.coalesce("name", F.lit("")) != ""))
    homers = state.filter(scored & (F.col("play") == "HR")).select(
        "game_id", F.col("pitcher").alias("name"), "no", "sub", "inn", F.col("name").alias("runner")
    )
    return traced.select("game_id", "name", "no", "sub", "inn", "runner").unionByName(homers)


def entry_margins(state: DataFrame) -> DataFrame:
    """Own minus opponent score when a pitcher first came in."""
    margin = F.when(F.col("half") == "0", F.col("home_score") - F.col("away_score")).otherwise(
        F.col("away_score") - F.col("home_score")
    )
    return (
        state.filter((F.col("kind") == "sub") & (F.col("label") == PITCHER))
        .groupBy("game_id", "name")
        .agg(F.min_by(margin, F.struct("no", "sub")).cast("int").alias("margin"))
    )


def starting_lineup(batters: DataFrame, pitchers: DataFrame, events: DataFrame) -> DataFrame:
    """Starting pitcher and fielders per fielding half ('0' is the home side).

    A batter who came in by substitution is not a starter. The later row wins a position.
    """
    from dugout.functions.plate import position_of_char

    replaced = (
        events.filter(rt.is_substitution(F.col("text")))
        .select("game_id", F.regexp_extract("text", rt.SUBSTITUTION, 3).alias("name"))
        .distinct()
    )
    half = F.when(F.col("side") == "home", "0").otherwise("1")
    fielders = (
        batters.join(replaced, ["game_id", "name"], "left_anti")
        .withColumn("position", position_of_char(F.substring("pos", 1, 1)))
        .filter(F.col("position").isNotNull())
    )
    defense = fielders.groupBy("game_id", half.alias("half")).agg(
        *[
            F.max_by("name", F.when(F.col("position") == p, F.col("pos_idx"))).alias(c)
            for p, c in DEFENSE.items()
        ]
    ).select(
        "game_id", "half",
        F.create_map(*[x for p, c in DEFENSE.items() for x in (F.lit(p), F.col(c))]).alias("defense"),
    )
    starters = pitchers.filter(F.col("pos_idx") == 0).select(
        "game_id", half.alias("half"), F.col("name").alias("pitcher")
    )
    return defense.join(starters, ["game_id", "half"], "full")


def relay_facts(
    events: DataFrame,
    starting: DataFrame | None,
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
    groups_per_chunk: int = GROUPS_PER_CHUNK,
) -> RelayFacts:
    """One pass over the relay.

    ``keep`` stores what is read several times: the state of the lines that matter (most lines of a
    relay are single pitches and end here) and the credits.
    """
    lines = parse_lines(by_chunk(events, groups_per_chunk)).drop("text")
    told = relay_state(with_group_facts(lines), starting)
    matters = (F.col("kind") != "other") & ((F.col("kind") != "sub") | (F.col("label") == PITCHER))
    unused = ("raw_class", "home_line", "double_line", "triple_line", "prev_base", "own_half", "out")
    state = keep(told.filter(matters | F.col("advance_line")).drop(*unused))
    finals = final_states(events)
    credits = keep(
        reduce(DataFrame.unionByName, [line_credits(state), inherited_runners(state, finals)])
    )
    return RelayFacts(
        credits, earned_candidates(state), entry_margins(state), finals, productive_outs(state)
    )
