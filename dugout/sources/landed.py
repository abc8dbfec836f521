"""Readers of landed JSON documents.

A document is either one file (its key is the file name without ``.json``) or, packed for scale,
one line ``{"key": .., "doc": {..}}`` of a JSON-lines file, which Spark can split. Every schema is
given, so nothing is inferred and unused fields are not parsed.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from dugout.functions import innings, rules
from dugout.functions.text import counter, strip

_GAME = (
    "STRUCT<gameId: STRING, statusCode: STRING, cancel: BOOLEAN, gameDateTime: STRING, "
    "gameDate: STRING, homeTeamCode: STRING, awayTeamCode: STRING, homeTeamName: STRING, "
    "awayTeamName: STRING, roundCode: STRING>"
)
SCHEDULE = f"result STRUCT<games: ARRAY<{_GAME}>>"
# A map, as the plate-appearance slots inn1, inn2, .. have no last number.
_BATTER = "MAP<STRING, STRING>"
_PITCHER = (
    "STRUCT<name: STRING, inn: STRING, hit: STRING, r: STRING, er: STRING, hr: STRING, bb: STRING, "
    "bbhp: STRING, kk: STRING, so: STRING, wls: STRING>"
)
RECORD = (
    "result STRUCT<recordData: STRUCT<"
    "gameInfo: STRUCT<gdate: STRING, stadium: STRING, hName: STRING, aName: STRING>, "
    f"battersBoxscore: STRUCT<home: ARRAY<{_BATTER}>, away: ARRAY<{_BATTER}>>, "
    f"pitchersBoxscore: STRUCT<home: ARRAY<{_PITCHER}>, away: ARRAY<{_PITCHER}>>, "
    "teamPitchingBoxscore: STRUCT<home: STRUCT<inn: STRING>, away: STRUCT<inn: STRING>>, "
    "etcRecords: ARRAY<STRUCT<how: STRING, result: STRING>>, "
    f"homeBatter: ARRAY<{_BATTER}>, awayBatter: ARRAY<{_BATTER}>, "
    f"homePitcher: ARRAY<{_PITCHER}>, awayPitcher: ARRAY<{_PITCHER}>>>"
)
RELAY = (
    "result STRUCT<textRelayData: STRUCT<textRelays: ARRAY<STRUCT<no: INT, inn: INT, "
    "homeOrAway: STRING, text: STRING, textOptions: ARRAY<STRUCT<text: STRING, "
    "currentGameState: STRUCT<out: STRING, base1: STRING, base2: STRING, base3: STRING, "
    "homeScore: STRING, awayScore: STRING>>>>>>>"
)
_LINEUP = "STRUCT<fullLineUp: ARRAY<STRUCT<playerName: STRING, positionName: STRING, batorder: STRING>>>"
PREVIEW = (
    "result STRUCT<previewData: STRUCT<gameInfo: STRUCT<stadium: STRING>, "
    f"homeTeamLineUp: {_LINEUP}, awayTeamLineUp: {_LINEUP}>>"
)
_ROW = (
    "name: STRING, team: STRING, opponent: STRING, date: STRING, stadium: STRING, position: STRING, "
    "role: STRING, inn: STRING, ab: INT, lp: INT, stat: MAP<STRING, STRING>"
)
DAY_FILE = f"date STRING, league STRING, batters ARRAY<STRUCT<{_ROW}>>, pitchers ARRAY<STRUCT<{_ROW}>>"


def read_documents(
    spark: SparkSession, path: str | Sequence[str], schema: str, packed: bool = False, days: Sequence[str] | None = None,
    base: str | None = None,
) -> DataFrame:
    """(key, result). With ``days``, only those ``game_date=`` folders under ``path`` are read.

    With ``base``, the folder above the ``game_date=`` folders of the files in ``path``, also doc (the file) and game_date.
    """
    reader = spark.read if base is None else spark.read.option("basePath", base)
    if packed:
        docs = reader.schema(f"key STRING, doc STRUCT<{schema.replace(' ', ': ', 1)}>").json(path)
    else:
        docs = reader.schema(schema).option("multiLine", True).json(path)
    if days is not None:
        docs = docs.filter(F.col("game_date").isin(*[date.fromisoformat(d) for d in days]))
    name = F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+?)\.json$", 1)
    parts = [F.col("key"), F.col("doc.result").alias("result")] if packed else [name.alias("key"), F.col("result")]
    if base is not None:
        parts = [F.col("_metadata.file_path").alias("doc"), *parts, F.col("game_date").cast("date").alias("game_date")]
    return docs.select(*parts)


def read_schedule(spark: SparkSession, path: str, league: str, packed: bool = False, days: Sequence[str] | None = None) -> DataFrame:
    """Games in schedule order."""
    return games_of(read_documents(spark, path, SCHEDULE, packed, days), league)


def games_of(docs: DataFrame, league: str) -> DataFrame:
    return docs.select(F.posexplode("result.games").alias("game_seq", "g")).select(
        F.col("g.gameId").alias("game_id"), F.lit(league).alias("league"),
        F.to_date("g.gameDate").alias("game_date"), F.col("g.gameDateTime").alias("game_datetime"),
        F.col("g.statusCode").alias("status_code"), F.coalesce("g.cancel", F.lit(False)).alias("cancel"),
        F.col("g.homeTeamCode").alias("home_team_code"), F.col("g.awayTeamCode").alias("away_team_code"),
        F.col("g.homeTeamName").alias("home_team_name"), F.col("g.awayTeamName").alias("away_team_name"),
        F.col("g.roundCode").alias("round_code"), "game_seq",
    )


def read_records(spark: SparkSession, path: str, packed: bool = False, days: Sequence[str] | None = None) -> DataFrame:
    """(game_id, record); a game without a box score has no row."""
    return records_of(read_documents(spark, path, RECORD, packed, days))


def records_of(docs: DataFrame) -> DataFrame:
    record = F.col("result.recordData")
    started = (
        record["gameInfo"].isNotNull()
        | (F.size(F.coalesce(record["homeBatter"], F.array())) > 0)
        | (F.size(F.coalesce(record["homePitcher"], F.array())) > 0)
    )
    return docs.filter(started).select(F.col("key").alias("game_id"), record.alias("record"))


def game_info(records: DataFrame) -> DataFrame:
    """One row a game. Spark takes these few columns for a sliver of the documents, so it would broadcast any number of games."""
    info = F.col("record.gameInfo")
    return records.select(
        "game_id", rules.compact_date(info["gdate"]).alias("info_date"), info["stadium"].alias("stadium"),
        info["hName"].alias("info_home"), info["aName"].alias("info_away"),
    ).hint("merge")


def _sides(records: DataFrame, home: Column, away: Column) -> DataFrame:
    """Both sides' rows from one pass over the records."""
    sides = F.array(*[F.struct(F.lit(side).alias("side"), rows.alias("rows")) for side, rows in (("home", home), ("away", away))])
    return records.select("game_id", F.inline(sides)).select("game_id", "side", F.posexplode("rows").alias("pos_idx", "p"))


def _plate_slots(player: Column) -> Column:
    """Slot texts of a batter in the order of their numbers, however many there are.

    The literal is looked for before the pattern, and the pairs are sorted without a comparator: both run for every batter.
    """
    number = lambda key: F.substring(key, 4, 9).try_cast("int")
    keys = F.filter(F.map_keys(player), lambda key: key.startswith("inn") & key.rlike("^inn[1-9][0-9]{0,8}$"))
    ordered = F.sort_array(F.transform(keys, lambda key: F.struct(number(key).alias("at"), key.alias("key"))))
    return F.transform(ordered, lambda slot: player[slot["key"]])


def batters(records: DataFrame, league: str = "kbo") -> DataFrame:
    """Batter lines. A counter that is not a number is NULL; see :func:`broken_games`."""
    second = league == "mlb"
    rows = (
        _sides(records, F.col("record.homeBatter"), F.col("record.awayBatter")) if second
        else _sides(records, F.col("record.battersBoxscore.home"), F.col("record.battersBoxscore.away"))
    )
    numbers = {n: n for n in ("ab", "hit", "run", "rbi", "hr", "bb", "sb", "hbp")}
    numbers["kk"] = "so" if second else "kk"
    return rows.select(
        "game_id", "side", "pos_idx", F.col("p.playerCode").alias("player_code"),
        F.coalesce("p.name", F.lit("")).alias("name"),
        F.coalesce("p.posName" if second else "p.pos", F.lit("")).alias("pos"),
        F.coalesce(F.col("p.substituteIn").try_cast("boolean"), F.lit(False)).alias("substitute_in"),
        *[counter(F.col(f"p.{source}")).alias(name) for name, source in numbers.items()],
        _plate_slots(F.col("p")).alias("pa_codes"),
    )


def pitchers(records: DataFrame, league: str = "kbo") -> DataFrame:
    """Pitcher lines; index 0 is the starter."""
    second = league == "mlb"
    rows = (
        _sides(records, F.col("record.homePitcher"), F.col("record.awayPitcher")) if second
        else _sides(records, F.col("record.pitchersBoxscore.home"), F.col("record.pitchersBoxscore.away"))
    )
    numbers = {n: n for n in ("hit", "r", "er", "hr", "bb", "bbhp")}
    numbers["kk"] = "so" if second else "kk"
    return rows.select(
        "game_id", "side", "pos_idx", F.coalesce("p.name", F.lit("")).alias("name"),
        F.col("p.inn").alias("inn"),
        *[counter(F.col(f"p.{source}")).alias(name) for name, source in numbers.items()],
        F.coalesce("p.wls", F.lit("")).alias("wls"),
    )


def broken_games(batter_rows: DataFrame, pitcher_rows: DataFrame, league: str = "kbo") -> DataFrame:
    """Games with a counter nobody can read. The whole game is set aside, not the row.

    Only what the league reads counts: its batters' hit-by-pitch and its innings text are numbers in the second
    league; the first takes the one from the plate codes and reads any innings text.
    """
    second = league == "mlb"

    def bad(rows: DataFrame, names, test: Column) -> DataFrame:
        for name in names:
            test = test | F.col(name).isNull()
        return rows.filter(test).select("game_id")

    counters = ("ab", "hit", "run", "rbi", "hr", "bb", "kk", "sb", *(("hbp",) if second else ()))
    junk = innings.outs_from_decimal(F.col("inn")).isNull() if second else F.lit(False)
    return bad(batter_rows, counters, F.lit(False)).unionByName(
        bad(pitcher_rows, ("hit", "r", "er", "hr", "bb", "bbhp", "kk"), junk)
    ).distinct()


def team_pitching(records: DataFrame) -> DataFrame:
    box = F.col("record.teamPitchingBoxscore")
    sides = F.array(
        *[F.struct(F.lit(s).alias("side"), box[s]["inn"].alias("inn")) for s in ("home", "away")]
    )
    return records.select("game_id", F.explode(sides).alias("s")).select("game_id", "s.*")


def etc_records(records: DataFrame) -> DataFrame:
    return records.select("game_id", F.posexplode("record.etcRecords").alias("idx", "e")).select(
        "game_id", "idx", F.col("e.how").alias("how"), strip(F.col("e.result")).alias("result")
    )


def _kept_innings(docs: DataFrame, stop_at_gap: bool, most: int | None) -> DataFrame:
    """Documents that hold lines: all of them, or those up to inning ``most`` or before the first gap."""
    filled = docs.filter(F.size("groups") > 0)
    if most is not None:
        filled = filled.filter(F.col("inning").between(1, most))
    if stop_at_gap:
        cut = _gaps(filled).groupBy("game_id").agg(F.min("first_missing").alias("cut"))
        filled = filled.join(cut, "game_id", "left").filter("cut is null or inning < cut").drop("cut")
    return filled


def _gaps(filled: DataFrame) -> DataFrame:
    before = F.lag("inning", 1, 0).over(Window.partitionBy("game_id").orderBy("inning"))
    known = filled.filter("inning is not null").select("game_id", "inning").withColumn("before", before)
    return known.filter("inning > before + 1").select(
        "game_id", (F.col("before") + 1).alias("first_missing"), (F.col("inning") - 1).alias("last_missing")
    )


def relay_gaps(spark: SparkSession, path: str, packed: bool = False, days: Sequence[str] | None = None) -> DataFrame:
    """(game_id, first_missing, last_missing): innings without lines before one that has some."""
    return gaps_of(read_documents(spark, path, RELAY, packed, days))


def gaps_of(docs: DataFrame) -> DataFrame:
    return _gaps(_kept_innings(_innings(docs), False, None))


def _innings(docs: DataFrame) -> DataFrame:
    """Keys are ``<game id>_<inning>``."""
    return docs.select(
        F.regexp_extract("key", r"^(.*)_(\d+)$", 1).alias("game_id"),
        F.regexp_extract("key", r"^(.*)_(\d+)$", 2).try_cast("int").alias("inning"),
        F.coalesce("result.textRelayData.textRelays", F.array()).alias("groups"),
    )


def read_relay(
    spark: SparkSession, path: str, packed: bool = False, days: Sequence[str] | None = None,
    stop_at_gap: bool = False, most: int | None = None,
) -> DataFrame:
    """First league: one row per line, with the game state after it.

    Every landed inning is read; ``stop_at_gap`` and ``most`` leave out those after a missing one or a number.
    """
    return lines_of(read_documents(spark, path, RELAY, packed, days), stop_at_gap, most)


def lines_of(docs: DataFrame, stop_at_gap: bool = False, most: int | None = None) -> DataFrame:
    docs = _kept_innings(_innings(docs), stop_at_gap, most)
    groups = docs.select("game_id", "inning", F.explode("groups").alias("g"))
    lines = groups.select(
        "game_id", "inning", F.col("g.no").alias("no"), F.col("g.homeOrAway").alias("half"),
        F.posexplode("g.textOptions").alias("sub", "o"),
    )
    state = F.col("o.currentGameState")

    def slot(name: str) -> Column:
        return F.coalesce(F.nullif(state[name], F.lit("")), F.lit("0"))

    return lines.select(
        "game_id", "no", "sub", F.col("inning").alias("inn"), "half",
        state["out"].try_cast("int").alias("out"),
        F.array(slot("base1"), slot("base2"), slot("base3")).alias("base"),
        F.coalesce(state["homeScore"].try_cast("int"), F.lit(0)).alias("home_score"),
        F.coalesce(state["awayScore"].try_cast("int"), F.lit(0)).alias("away_score"),
        F.coalesce("o.text", F.lit("")).alias("text"),
    )


def split_lines(groups: DataFrame) -> DataFrame:
    """Second league: a group's lines are joined by ``<br/>``; blanks go but keep their number."""
    return (
        groups.select(
            "game_id", "no", "inn", "half",
            F.posexplode(F.split(F.coalesce("text", F.lit("")), "<br/>")).alias("sub", "line"),
        )
        .withColumn("text", strip(F.col("line")))
        .filter(F.col("text") != "")
        .select("game_id", "no", "sub", "inn", "half", "text")
    )


def read_relay_second(
    spark: SparkSession, path: str, packed: bool = False, days: Sequence[str] | None = None,
    stop_at_gap: bool = False, most: int | None = None,
) -> DataFrame:
    """Second league; innings as in :func:`read_relay`."""
    return second_lines_of(read_documents(spark, path, RELAY, packed, days), stop_at_gap, most)


def second_lines_of(docs: DataFrame, stop_at_gap: bool = False, most: int | None = None) -> DataFrame:
    docs = _kept_innings(_innings(docs), stop_at_gap, most)
    return split_lines(
        docs.select("game_id", F.explode("groups").alias("g")).select(
            "game_id", F.col("g.no").alias("no"), F.col("g.inn").alias("inn"),
            F.col("g.homeOrAway").alias("half"), F.col("g.text").alias("text"),
        )
    )


def read_lineups(spark: SparkSession, path: str, packed: bool = False, days: Sequence[str] | None = None) -> DataFrame:
    """Announced starters: the pitcher, and batters with their order."""
    return lineups_of(read_documents(spark, path, PREVIEW, packed, days))


def lineups_of(docs: DataFrame) -> DataFrame:
    def side(name: str) -> DataFrame:
        return docs.select(
            F.col("key").alias("game_id"), F.lit(name).alias("side"),
            F.posexplode(f"result.previewData.{name}TeamLineUp.fullLineUp").alias("idx", "e"),
        )

    entries = side("home").unionByName(side("away"))
    starts = F.coalesce(F.col("e.positionName") == "선발투수", F.lit(False))
    order = F.nullif(F.nullif(F.col("e.batorder"), F.lit("")), F.lit("0")).try_cast("int")
    named = entries.filter(
        (F.coalesce("e.playerName", F.lit("")) != "") & (starts | order.isNotNull())
    )
    # a later entry replaces an earlier one: one starting pitcher per side, one order per name
    pitcher = named.filter(starts).groupBy("game_id", "side").agg(
        F.max_by("e.playerName", "idx").alias("name")
    ).withColumn("is_starting_pitcher", F.lit(True))
    batter = named.filter(~starts).groupBy(
        "game_id", "side", F.col("e.playerName").alias("name")
    ).agg(F.max_by(order, "idx").alias("bat_order"))
    both = batter.join(pitcher, ["game_id", "side", "name"], "full")
    return both.withColumn("is_starting_pitcher", F.coalesce("is_starting_pitcher", F.lit(False)))


def preview_stadiums(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("key").alias("game_id"), F.col("result.previewData.gameInfo.stadium").alias("stadium"))


def read_day_files(spark: SparkSession, path: str, cost_field: str | None = None) -> DataFrame:
    """Stored day files to rows: kind, date from the file's content or else its name.

    ``cost_field`` names the roster-cost field of a row, if the files have one.
    """
    schema = DAY_FILE
    if cost_field:
        schema = schema.replace("lp: INT,", f"lp: INT, `{cost_field}`: INT,")
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    name_date = F.to_date(
        F.nullif(F.regexp_extract(F.col("_metadata.file_name"), r"(\d{8})\.json$", 1), F.lit("")), "yyyyMMdd"
    )
    docs = docs.withColumns(
        {
            "game_date": F.coalesce(F.try_to_date(F.col("date")), name_date),
            "league": F.coalesce("league", F.lit("kbo")),
        }
    )

    def rows(kind: str, column: str) -> DataFrame:
        return docs.select(
            "league", "game_date", F.lit(kind).alias("kind"), F.posexplode(column).alias("row_id", "r")
        ).select("league", "game_date", "kind", "row_id", "r.*")

    out = rows("batter", "batters").unionByName(rows("pitcher", "pitchers")).drop("date")
    return out.withColumnRenamed(cost_field, "roster_cost") if cost_field else out
