"""Relay credits onto box rows, then the points ledger."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from dugout.functions import relaytext as rt, rules, scoring
from dugout.model import BATTER_WEIGHTS as BW, FIELD_COUNTERS, PITCHER_WEIGHTS as PW
from dugout.operators.relay import CREDIT_COLUMNS, END_OF_GAME, RelayFacts

DEFAULT_MODE = 3
DEFAULT_DH = True
FIELD_RULES = tuple((mode, dh) for mode in (1, 2, 3) for dh in (True, False))
PLAYER = ["game_id", "name"]
PITCHER_RELAY = (
    "2B_A", "3B_A", "INHERITED_SCORED", "INHERITED_STRANDED", "CS_A", "SB_ALLOWED", "PICKOFF_A",
)
# Fixed ledger texts.
AMBIGUOUS_TEXT = "동명이인 선수가 있어 세부 내역을 표시할 수 없습니다 (박스스코어 합계 기준 LP)"
RESIDUAL_TEXT = "기타 보정 (박스스코어 기준 상한 등)"
CAP_TEXT = " (1경기 1회 상한, 추가 반영 없음)"


def flag_ambiguous(rows: DataFrame) -> DataFrame:
    """A name that occurs twice in a game cannot be told apart in the relay."""
    twice = (
        rows.groupBy(*PLAYER).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1)
        .select(*PLAYER, F.lit(True).alias("__twice"))
    )
    return rows.join(twice, PLAYER, "left").withColumn(
        "ambiguous", F.coalesce("__twice", F.lit(False))
    ).drop("__twice")


def position_events(credits: DataFrame) -> DataFrame:
    """Fielding credits with the position they were made at, first league's event list."""
    return credits.filter(F.col("tag").isin(*FIELD_COUNTERS)).select(
        "game_id", "name", F.col("tag"), "pos", "no", "sub", "ord"
    )


def field_counts(events: DataFrame, registered: DataFrame, mode: Column, dh: Column, extra: list[str]) -> DataFrame:
    """Counters a player gets under a position rule; double and triple plays count once.

    ``registered`` is (game_id, name, position) plus ``extra`` key columns such as the rule itself.
    """
    allowed = rules.position_allowed(F.col("pos"), F.col("position"), mode, dh)
    counted = (
        events.groupBy(*PLAYER, "tag", "pos").agg(F.count(F.lit(1)).alias("c"))
        .join(registered, PLAYER)
        .withColumn("c", F.when(allowed, F.col("c")).otherwise(0))
    )

    def total(tag: str) -> Column:
        value = F.coalesce(F.sum(F.when(F.col("tag") == tag, F.col("c"))), F.lit(0))
        if tag in ("DP_FIELD", "TP_FIELD"):
            value = F.least(value, F.lit(1))
        return value.cast("int").alias(tag)

    return counted.groupBy(*PLAYER, *extra).agg(*[total(t) for t in FIELD_COUNTERS])


def _one_row(found: list[DataFrame]) -> DataFrame:
    """What several frames of one row a player know of a player, in one row: wide box rows are then joined once, not with each."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    return rows.groupBy(*PLAYER).agg(*[F.max(c).alias(c) for c in rows.columns if c not in PLAYER])


def merge_batters(
    batters: DataFrame, facts: RelayFacts, mode: int = DEFAULT_MODE, dh: bool = DEFAULT_DH
) -> DataFrame:
    """Fielding counters, bunt-out relief and productive outs; then the score."""
    rows = flag_ambiguous(batters)
    clear = ~F.col("ambiguous")
    registered = rows.filter(clear).select(*PLAYER, "position")
    fields = field_counts(
        position_events(facts.credits), registered, F.lit(mode), F.lit(dh), []
    ).select(*PLAYER, *[F.col(c).alias(f"__{c}") for c in FIELD_COUNTERS])
    bunts = (
        facts.credits.filter(F.col("tag") == "PLAY:BUNT_OUT")
        .groupBy(*PLAYER).agg(F.count(F.lit(1)).cast("int").alias("__bunts"))
    )
    joined = rows.join(_one_row([fields, bunts, facts.advances]), PLAYER, "left")
    zero = F.lit(0)
    changed = {c: F.when(clear, F.coalesce(f"__{c}", zero)).otherwise(zero) for c in FIELD_COUNTERS}
    changed["GO"] = F.when(
        clear, F.greatest(F.col("GO") - F.coalesce("__bunts", zero), zero)
    ).otherwise(F.col("GO"))
    changed["ADVANCE_OUT"] = F.when(clear, F.coalesce("advance", zero)).otherwise(zero)
    drop = ["__bunts", "advance", *[f"__{c}" for c in FIELD_COUNTERS]]
    return joined.withColumns(changed).drop(*drop).withColumn("lp", scoring.batter_lp())


def merge_pitchers(pitchers: DataFrame, facts: RelayFacts) -> DataFrame:
    """Relay counters and save opportunities; then the score."""
    rows = flag_ambiguous(pitchers)
    clear = ~F.col("ambiguous")
    tag = F.col("tag")
    extra = (
        facts.credits.filter((F.col("role") == "pitch") & tag.isin(*PITCHER_RELAY))
        .groupBy(*PLAYER)
        .agg(*[F.count_if(tag == c).cast("int").alias(f"__{c}") for c in PITCHER_RELAY])
    )
    joined = (
        rows.join(_one_row([extra, facts.margins]), PLAYER, "left")
        .join(facts.finals.select("game_id", "home_score", "away_score"), "game_id", "left")
    )
    won = F.when(F.col("side") == "home", F.col("home_score") > F.col("away_score")).otherwise(
        F.col("away_score") > F.col("home_score")
    )
    zero = F.lit(0)
    changed = {
        c: F.when(clear, F.coalesce(f"__{c}", zero)).otherwise(zero) for c in PITCHER_RELAY
    }
    changed["SAVE_OPP"] = clear & scoring.save_opportunity(won, F.col("margin"), F.col("OUT"))
    drop = ["margin", "home_score", "away_score", *[f"__{c}" for c in PITCHER_RELAY]]
    return joined.withColumns(changed).drop(*drop).withColumn("lp", scoring.pitcher_lp())


def cap_once(credits: DataFrame) -> DataFrame:
    """From the second double- or triple-play share of a game on, a line is worth nothing.

    The first share is found with an aggregate, so a player with very many lines needs no window.
    """
    shared = F.col("tag").isin("DP_FIELD", "TP_FIELD")
    place = F.struct("no", "sub", "ord")
    shares = credits.filter(shared)
    first = shares.groupBy(*PLAYER, "role", "tag").agg(F.min(place).alias("__first"))
    later = place > F.col("__first")
    capped = (
        shares.join(first, [*PLAYER, "role", "tag"])
        .withColumns(
            {
                "text": F.when(later, F.concat("text", F.lit(CAP_TEXT))).otherwise(F.col("text")),
                "points": F.when(later, 0).otherwise(F.col("points")),
            }
        )
        .select(*CREDIT_COLUMNS)
    )
    return credits.filter(~shared).select(*CREDIT_COLUMNS).unionByName(capped)


def earned_lines(earned: DataFrame, pitchers: DataFrame, groups_per_chunk: int = 16384) -> DataFrame:
    """The first ER candidates, by inning, up to the number the box score states.

    Candidates are counted per inning and chunk of the game first; only those counts are scanned
    per pitcher, and rows are numbered inside one inning and chunk.
    """
    limits = pitchers.filter(~F.col("ambiguous") & (F.col("ER") > 0)).select(*PLAYER, F.col("ER"))
    cell = [*PLAYER, "inn", "chunk"]
    rows = earned.withColumn("chunk", F.floor(F.col("no") / groups_per_chunk).cast("int"))
    ahead = Window.partitionBy(*PLAYER).orderBy("inn", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n")).select(
        *cell, F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before")
    )
    inside = Window.partitionBy(*cell).orderBy("no", "sub")
    return (
        rows.withColumn("__row", F.row_number().over(inside))
        .join(offsets, cell)
        .join(limits, PLAYER)
        .filter(F.col("__before") + F.col("__row") <= F.col("ER"))
        .select(
            "game_id", "name", F.lit("pitch").alias("role"), F.lit(END_OF_GAME).alias("no"),
            F.lit(1).alias("sub"), (F.col("__before") + F.col("__row")).cast("int").alias("ord"), "inn",
            F.concat(F.lit("자책점 허용 ("), F.col("runner"), F.lit(" 득점)")).alias("text"),
            F.lit("ER").alias("tag"), F.lit(1).alias("n"), F.lit(PW["ER"]).alias("points"),
            F.lit(None).cast("string").alias("pos"),
        )
    )


def _box_line(when: Column, inn: Column, text: Column | str, tag: str, n: Column, points: Column) -> Column:
    body = F.struct(
        inn.cast("int").alias("inn"), (text if isinstance(text, Column) else F.lit(text)).alias("text"),
        F.lit(tag).alias("tag"), n.cast("int").alias("n"), points.cast("int").alias("points"),
    )
    return F.when(when, body)


def _explode_lines(rows: DataFrame, role: str, lines: list[Column], sub: int) -> DataFrame:
    return rows.select(
        "game_id", "name", F.lit(role).alias("role"), F.lit(END_OF_GAME).alias("no"),
        F.lit(sub).alias("sub"),
        F.posexplode(F.filter(F.array(*lines), lambda e: e.isNotNull())).alias("ord", "e"),
    ).select(
        "game_id", "name", "role", "no", "sub", "ord", "e.inn", "e.text", "e.tag", "e.n", "e.points",
        F.lit(None).cast("string").alias("pos"),
    )


def _log_ends(log: DataFrame, role: str) -> DataFrame:
    """Last inning a player is logged in, and the inning of the first home run."""
    place = F.struct("no", "sub", "ord")
    return log.filter(F.col("role") == role).groupBy(*PLAYER).agg(
        F.max_by("inn", F.when(F.col("inn").isNotNull(), place)).alias("last_inn"),
        F.min_by("inn", F.when(F.col("tag") == "PLAY:HR", place)).alias("hr_inn"),
    )


def pitcher_box_lines(pitchers: DataFrame, log: DataFrame) -> DataFrame:
    """Ledger lines that only the box score knows."""
    rows = pitchers.filter(~F.col("ambiguous")).join(_log_ends(log, "pitch"), PLAYER, "left")
    last, one, none = F.col("last_inn"), F.lit(1), F.lit(None)

    def counted(tag: str, word: str) -> Column:
        n = F.col(tag)
        return _box_line(
            n != 0, none, F.concat(F.lit(f"{word} "), n.cast("string"), F.lit("개")), tag, n, n * PW[tag]
        )

    def flag(tag: str, text: str, inn: Column, unless: str | None = None) -> Column:
        on = F.col(tag).cast("int") != 0
        if unless:
            on = on & (F.col(unless).cast("int") == 0)
        return _box_line(on, inn, text, tag, one, F.lit(PW[tag]))

    return _explode_lines(
        rows, "pitch",
        [
            counted("WP", "폭투"), counted("BK", "보크"),
            flag("QSPLUS", "퀄리티스타트+", F.lit(7)), flag("QS", "퀄리티스타트", F.lit(6), "QSPLUS"),
            flag("HOLD", "홀드", last), flag("SAVE", "세이브", last), flag("BLOWN", "블론 세이브", last),
            flag("PERFECT", "퍼펙트게임", last), flag("NOHIT", "노히트", last, "PERFECT"),
            flag("SHO", "완봉", last), flag("CG", "완투", last, "SHO"),
        ],
        sub=2,
    )


def batter_box_lines(batters: DataFrame, log: DataFrame, mentions: DataFrame | None) -> DataFrame:
    """Errors by inning, grand-slam and cycle bonuses."""
    clear = batters.filter(~F.col("ambiguous"))
    rows = clear.join(_log_ends(log, "bat"), PLAYER, "left")
    slams = F.col("GRANDSLAM")
    bonuses = _explode_lines(
        rows, "bat",
        [
            _box_line(slams != 0, F.col("hr_inn"), "만루홈런 보너스", "GRANDSLAM", slams, slams * BW["GRANDSLAM"]),
            _box_line(F.col("CYCLE").cast("int") != 0, F.col("last_inn"), "사이클히트 보너스", "CYCLE",
                      F.lit(1), F.lit(BW["CYCLE"])),
        ],
        sub=2,
    )
    if mentions is None:
        return bonuses
    # Records are numbered without an end, so their place is a BIGINT.
    place = F.col("idx").cast("bigint") * 1000 + F.col("item")
    errors = mentions.filter(F.col("counter") == "E").join(clear.select(*PLAYER), PLAYER).select(
        "game_id", "name", F.lit("bat").alias("role"), F.lit(END_OF_GAME).alias("no"),
        F.lit(1).alias("sub"), place.alias("ord"), "inn",
        F.lit("실책").alias("text"), F.lit("E").alias("tag"), F.lit(1).alias("n"),
        F.lit(BW["E"]).alias("points"), F.lit(None).cast("string").alias("pos"),
    )
    return errors.unionByName(bonuses)


def play_ledger(
    batters: DataFrame,
    pitchers: DataFrame,
    facts: RelayFacts,
    mentions: DataFrame | None = None,
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Every player's points, line by line, so that the lines add up to the score.

    ``keep`` stores the lines, which the residual reads a second time.
    """
    scored = batters.select(*PLAYER, F.lit("bat").alias("role"), "lp", "ambiguous").unionByName(
        pitchers.select(*PLAYER, F.lit("pitch").alias("role"), "lp", "ambiguous")
    )
    owners = scored.filter(~F.col("ambiguous")).select(*PLAYER, "role")
    log = cap_once(facts.credits.join(owners, [*PLAYER, "role"], "left_semi"))
    parts = [
        log,
        earned_lines(facts.earned, pitchers),
        pitcher_box_lines(pitchers, log),
        batter_box_lines(batters, log, mentions),
    ]
    lines = keep(reduce(DataFrame.unionByName, parts))
    return lines.unionByName(residual_lines(scored, lines))


def residual_lines(scored: DataFrame, lines: DataFrame) -> DataFrame:
    """What the lines leave open, and one line for a name that cannot be told apart."""
    sums = lines.groupBy(*PLAYER, "role").agg(F.sum("points").alias("__sum"))
    rest = F.when(F.col("ambiguous"), F.col("lp")).otherwise(
        F.col("lp") - F.coalesce("__sum", F.lit(0))
    )
    return (
        scored.join(sums, [*PLAYER, "role"], "left")
        .withColumn("points", rest.cast("int"))
        .filter(F.col("ambiguous") | (F.col("points") != 0))
        .select(
            "game_id", "name", "role", F.lit(END_OF_GAME).alias("no"), F.lit(9).alias("sub"),
            F.lit(0).alias("ord"), F.lit(None).cast("int").alias("inn"),
            F.when(F.col("ambiguous"), AMBIGUOUS_TEXT).otherwise(RESIDUAL_TEXT).alias("text"),
            F.lit("").alias("tag"), F.lit(0).alias("n"), "points",
            F.lit(None).cast("string").alias("pos"),
        )
    )


def ledger_tags(ledger: DataFrame) -> DataFrame:
    """Ledger with the counters of each line as MAP<STRING,INT>."""
    play = F.regexp_replace("tag", "^PLAY:", "")
    empty = F.create_map().cast("map<string,int>")
    tags = (
        F.when(F.col("tag").startswith("PLAY:"), F.coalesce(rt.class_tags(play), empty))
        .when(F.col("tag") != "", F.create_map(F.col("tag"), F.col("n")))
        .otherwise(empty)
    )
    return ledger.withColumn("tags", tags)


def inning_totals(ledger: DataFrame) -> DataFrame:
    """Points per player and inning; a NULL inning is the whole game and sorts last."""
    return ledger.groupBy(*PLAYER, "role", "inn").agg(
        F.sum("points").alias("points"), F.count(F.lit(1)).alias("lines")
    )


def rescore_modes(
    batters: DataFrame, events: DataFrame, modes: Sequence[tuple[int, bool]] = FIELD_RULES
) -> DataFrame:
    """Scores of players with fielding credits under every (mode, dh) rule in ``modes``."""
    players = events.select(*PLAYER).distinct()
    rule = F.explode(
        F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(d).alias("dh")) for m, d in modes])
    )
    rows = batters.filter(~F.col("ambiguous")).join(players, PLAYER, "left_semi").withColumn("__rule", rule).select(
        *batters.columns, "__rule.mode", "__rule.dh"
    )
    registered = rows.select(*PLAYER, "position", "mode", "dh")
    fresh = field_counts(events, registered, F.col("mode"), F.col("dh"), ["mode", "dh"]).select(
        *PLAYER, "mode", "dh", *[F.col(c).alias(f"__{c}") for c in FIELD_COUNTERS]
    )
    delta = reduce(
        lambda a, b: a + b,
        [(F.col(f"__{c}") - scoring.as_count(F.col(c))) * BW[c] for c in FIELD_COUNTERS],
    )
    return (
        rows.join(fresh, [*PLAYER, "mode", "dh"])
        .withColumn("lp", F.col("lp") + delta)
        .withColumns({c: F.col(f"__{c}") for c in FIELD_COUNTERS})
        .drop(*[f"__{c}" for c in FIELD_COUNTERS])
    )
