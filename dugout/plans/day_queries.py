"""Queries that go through landed documents, staged days and published versions, and their SQL.

Documents are made from the driver's whole tables, landed as packed JSON, staged and read back; the SQL derives the
same rows from the tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dugout.functions import innings
from dugout.model import TEAMS
from dugout.operators import boards, differ, positions as pos
from dugout.plans import bindings as b
from dugout.plans import oracles as o
from dugout.plans.queries import tidy
from dugout.session import OPEN_FILES, SHORT_SHUFFLES, SORTED_GROUPS, settings, shared_folder
from dugout.sources import landed, published, staging

#: Days that documents are landed under.
DAYS = 14
#: Most documents in a landed file.
FILE_DOCS = 100_000


def _staged(docs: DataFrame, kind: str, league: str = "kbo") -> DataFrame:
    """``docs`` (game_date, key, doc) landed as packed JSON, staged, and read back."""
    spark = docs.sparkSession
    root = f"{shared_folder(spark)}/landing-{uuid.uuid4().hex}"
    with settings(spark, SHORT_SHUFFLES | OPEN_FILES | SORTED_GROUPS):
        # A compressed file cannot be split, so it ends after some documents.
        landing = docs.write.partitionBy("game_date").option("maxRecordsPerFile", FILE_DOCS)
        landing.json(f"{root}/{league}/{kind}", compression="gzip")
        staging.refresh(spark, root, f"{root}/staged", league, packed=True)
    return staging.documents(spark, f"{root}/staged", league, kind)


def _day(number: Column) -> Column:
    return F.date_add(F.lit("2026-05-01").cast("date"), (number % DAYS).cast("int"))


def _in_order(entry: Column, which: Column) -> Column:
    """The p of each entry (at, p) of one side, in the order of at. A game has a handful of entries."""
    return F.sort_array(F.collect_list(F.when(which, entry)))["p"]


def _record_docs(games: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """Box documents of grouped games: game_id and the columns of ``parts``."""
    key = F.col("game_id").cast("bigint")
    info = F.struct(
        F.date_format(_day(key), "yyyyMMdd").alias("gdate"), b.pick(TEAMS, key).alias("stadium"),
        b.pick(TEAMS, key + 1).alias("hName"), b.pick(TEAMS, key + 2).alias("aName"))
    record = F.struct(info.alias("gameInfo"), *[value.alias(name) for name, value in parts.items()])
    doc = F.struct(F.struct(record.alias("recordData")).alias("result"))
    return games.select(_day(key).alias("game_date"), F.col("game_id").alias("key"), doc.alias("doc"))


def landed_batters(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = [F.col("pa_codes")[i].alias(f"inn{i + 1}") for i in range(4)]
    man = F.struct(
        F.col("player_code").alias("playerCode"), "name", "pos", F.col("substitute_in").alias("substituteIn"),
        "ab", "hit", "run", "rbi", "hr", "bb", "kk", "sb", *slots)
    codes = F.array_join(F.filter("pa_codes", lambda x: x != ""), "|").alias("codes")
    entry = F.struct(F.struct("pos_idx", "player_code", "ab", "substitute_in", codes).alias("at"), man.alias("p"))
    games = b.line_batters(spark, sf_dir, by_game=True).groupBy("order").agg(
        F.first("game_id").alias("game_id"), *[_in_order(entry, F.col("side") == side).alias(side) for side in ("home", "away")])
    docs = _staged(_record_docs(games, {"battersBoxscore": F.struct("home", "away")}), "record")
    rows = landed.batters(landed.records_of(docs))
    return tidy(rows.select(*[c for c in rows.columns if c != "pa_codes"], codes))


def landed_pitchers(spark: SparkSession, sf_dir: str) -> DataFrame:
    arm = F.struct("name", "inn", "hit", "r", "er", "hr", "bb", "bbhp", "kk", "wls")
    entry = F.struct(F.struct("pos_idx", "part", "name").alias("at"), arm.alias("p"))
    games = b.line_pitchers(spark, sf_dir).groupBy("game_id").agg(
        *[_in_order(entry, F.col("side") == side).alias(side) for side in ("home", "away")])
    docs = _staged(_record_docs(games, {"pitchersBoxscore": F.struct("home", "away")}), "record")
    return tidy(landed.pitchers(landed.records_of(docs)))


def landed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Special records with the stadium and day of their game."""
    entry = F.struct(F.struct("idx", "supp").alias("at"), F.struct("how", F.concat(F.lit(" "), "result", F.lit("　")).alias("result")).alias("p"))
    games = b.line_records(spark, sf_dir).groupBy("game_id").agg(_in_order(entry, F.lit(True)).alias("records"))
    docs = landed.records_of(_staged(_record_docs(games, {"etcRecords": F.col("records")}), "record"))
    return tidy(landed.etc_records(docs).join(landed.game_info(docs), "game_id"))


def _relay_docs(groups: DataFrame, body: list[Column]) -> DataFrame:
    """One document piece for each group of an inning: game_id, inn and the columns of ``body``."""
    relays = F.array(F.struct(*body)).alias("textRelays")
    doc = F.struct(F.struct(F.struct(relays).alias("textRelayData")).alias("result"))
    return groups.select(_day(F.col("game_id").cast("bigint")).alias("game_date"), F.concat_ws("_", "game_id", "inn").alias("key"), doc.alias("doc"))


def landed_relay(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    state = F.struct(
        text("out").alias("out"), *[F.nullif(F.col("base")[i], F.lit("0")).alias(f"base{i + 1}") for i in range(3)],
        text("home_score").alias("homeScore"), text("away_score").alias("awayScore"))
    entry = F.struct(F.col("sub").alias("at"), F.struct("text", state.alias("currentGameState")).alias("p"))
    groups = b.relay_events(spark, sf_dir).groupBy("game_id", "no", "inn", "half").agg(_in_order(entry, F.lit(True)).alias("lines"))
    docs = _staged(_relay_docs(groups, [F.col("no"), F.col("half").alias("homeOrAway"), F.col("lines").alias("textOptions")]), "relay")
    lines = landed.lines_of(docs)
    return tidy(lines.withColumn("base", F.array_join("base", ",")))


def landed_relay_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some lines have a blank one before them, which takes a number and no row."""
    said = F.when(F.col("sub") % 5 == 0, F.concat(F.lit(" <br/>"), "text")).otherwise(F.col("text"))
    entry = F.struct(F.col("sub").alias("at"), said.alias("p"))
    groups = b.relay_events(spark, sf_dir).groupBy("game_id", "no", "inn", "half").agg(_in_order(entry, F.lit(True)).alias("lines"))
    body = [F.col("no"), F.col("inn"), F.col("half").alias("homeOrAway"), F.array_join("lines", "<br/>").alias("text")]
    return tidy(landed.second_lines_of(_staged(_relay_docs(groups, body), "relay", "mlb")))


def rescored_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day scored, every third month scored again, June left without rows; a third run is lost before it publishes."""
    mart = f"{shared_folder(spark)}/mart-{uuid.uuid4().hex}"
    month = F.month("game_date")
    rows = b.table(spark, sf_dir, "orders").select(
        F.lit("kbo").alias("league"), F.to_date("o_orderdate").alias("game_date"), F.col("o_orderkey").cast("string").alias("game_id"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("name"), (F.col("o_custkey") % 50).cast("int").alias("lp"))
    rows = rows.withColumn("game_date", F.to_date(F.date_trunc("month", "game_date")))
    days = rows.select("league", "game_date").distinct()
    runs = [
        (rows.withColumn("lp", F.col("lp") + 1), days.withColumn("final", month % 2 == 0)),
        (rows.where((month % 3 == 0) & (month != 6)), days.where(month % 3 == 0).withColumn("final", F.lit(True))),
        (rows.withColumn("lp", F.lit(0)), None),
    ]
    for scored, finals in runs:
        version = published.new_version()
        published.write(scored, mart, "batters", version, ("-lp", "game_id", "name"))
        if finals is not None:
            published.publish(finals, mart, version)
    found = published.read(spark, mart, "batters").groupBy("league", "game_date").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("lp").alias("lp"), F.max_by("name", F.struct("lp", "game_id")).alias("top_name"))
    known = published.pointers(spark, mart).select("league", "game_date", "final").join(found, ["league", "game_date"], "left")
    return tidy(known.withColumn("rows", F.coalesce("rows", F.lit(0))))


def rolling_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered positions over the 14 days up to every month's end, from one partial a day."""
    games = b.order_games(spark, sf_dir)
    ends = games.select(F.last_day("game_date").alias("end_date"))
    rows = pos.fielding_rows(b.line_batters(spark, sf_dir), b.line_team_pitching(spark, sf_dir), pos.reached(games, ends))
    table = pos.rolling_table(pos.day_partials(rows), ends)
    return tidy(table.select(
        "end_date", "player_code", "name", "team", "games", "dh_games", "auto_position", F.size("innings_by_position").alias("positions")))


def live_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thresholds of kth_threshold from games' states: provisional scores, then the games one delivery after the other."""
    rows = b.board_rows(spark, sf_dir).withColumn("game_id", F.pmod(F.xxhash64("name"), F.lit(7)))
    provisional = rows.withColumn("lp", F.col("lp") + (F.col("row_id") % 5 * 40 - 60).cast("int"))
    states = boards.pool_states(provisional)
    for games in ((1, 4, 6), (5, 0), (3, 2)):
        delivered = rows.where(F.col("game_id").isin(*games))
        states = boards.replace_states(states, delivered.select("game_date", "game_id").distinct(), boards.pool_states(delivered))
    # Merged in two parts, and these with each other.
    parts = [boards.merge_states(states.where(F.col("game_id") % 2 == part)) for part in (1, 0)]
    return tidy(boards.thresholds_of(parts[0].unionByName(parts[1])))


def mart_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitcher rows read by the innings rule of the first league and by that of the second."""
    rows = b.line_pitchers(spark, sf_dir).withColumns({
        "league": F.lit("kbo"), "game_date": _day(F.col("game_id").cast("bigint")),
        "quick": F.col("bb") + F.col("hit") == 0})

    def read(outs: Column) -> DataFrame:
        read = rows.select("*", b.computed(F.coalesce(outs, F.lit(0)), "OUT")).withColumn("LONG", F.col("OUT") >= 18)
        return read.where((F.col("OUT") > 0) | ~F.col("quick"))

    before, after = (read(f(F.col("inn"))) for f in (innings.outs_from_fraction, innings.outs_from_decimal))
    found = differ.mart_difference(
        before, after, ("league", "game_date"), ("game_id", "side", "pos_idx", "part", "name"), ("hit", "er", "inn", "OUT", "LONG"))
    return tidy(found.drop("league"))


ALL: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        landed_batters, landed_pitchers, landed_records, landed_relay, landed_relay_second, rescored_days, rolling_positions,
        live_threshold, mart_diff)
}

_ROW_OF_SIDE = "row_number() OVER (PARTITION BY game_id, side ORDER BY {}) - 1"
_TEXT = f"{o.lit(b.SENTENCES)}[CAST(t+1 AS INT)]"
for _mark, _value in {"i": "CAST(inn AS VARCHAR)", "b": "bat", "r": "run", "f": "fin", "p": "pin", "q": "fs||'P'||((k//4)%4)"}.items():
    _TEXT = f"replace({_TEXT}, '{{{_mark}}}', {_value})"

# By hand: a whole number is innings, a point is followed by outs, anything else is no number.
OUTS_SECOND = {"5 ⅔": 0, "⅓": 0, "6": 18, "": 0, "4.4": 16, "abc": 0, "7": 21, "6 ⅓": 0, "8": 24, "9": 27}
_LETTERS = "CASE chars[c.i] " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in o.LETTER_POS.items()) + " END"

SQL: dict[str, str] = {
    "rolling_positions": f"""WITH {o.LINE_BATTERS},{o.ORDER_GAMES},
      tm AS (SELECT CAST(l_orderkey AS VARCHAR) game_id, CASE WHEN l_linestatus='F' THEN 'home' ELSE 'away' END side,
        max(CASE WHEN regexp_full_match(t,'[0-9]') THEN CAST(t AS INT) ELSE 0 END) di
        FROM (SELECT *, {o.pick(b.INNING_TEXTS, 'l_partkey+l_linenumber')} t FROM lineitem) GROUP BY ALL),
      ends AS (SELECT DISTINCT last_day(game_date) d FROM og),
      pw AS (SELECT d, lb.player_code, lb.name, CASE WHEN side='home' THEN home_name ELSE away_name END team, di,
          list_filter(string_split(pos,''), lambda c: c IN ({", ".join(f"'{c}'" for c in o.LETTER_POS)})) chars,
          row_number() OVER (PARTITION BY d, lb.player_code ORDER BY og.game_date DESC, og.game_seq, lb.game_id,
            CASE WHEN side='home' THEN 0 ELSE 1 END, pos_idx) ord
        FROM lb JOIN og USING (game_id) JOIN tm USING (game_id, side) JOIN ends ON og.game_date BETWEEN d - 13 AND d WHERE og.status_code='RESULT'),
      ps AS (SELECT d, player_code, ord, c.i char_no, {_LETTERS} position, di/len(chars) share FROM pw, unnest(range(1, len(chars)+1)) c(i)),
      pp AS (SELECT d, player_code, position, round(sum(share),9) innings, min(ord*10+char_no) seen FROM ps GROUP BY ALL),
      bestp AS (SELECT d, player_code, position FROM pp QUALIFY row_number() OVER (PARTITION BY d, player_code ORDER BY innings DESC, seen)=1),
      np AS (SELECT d, player_code, count(*) positions FROM pp GROUP BY ALL),
      pt AS (SELECT d, player_code, arg_min(pw.name, ord) "name", arg_max(team, ord) team, count(*) games, count(*) FILTER (len(chars)=0) dh_games FROM pw GROUP BY ALL)
      SELECT strftime(pt.d,'%Y-%m-%d') end_date, player_code, "name", team, games, dh_games,
        coalesce(bestp.position, CASE WHEN dh_games>0 THEN '지명타자' ELSE '미상' END) auto_position, coalesce(positions, 0) positions
      FROM pt LEFT JOIN bestp USING (d, player_code) LEFT JOIN np USING (d, player_code)""",
    "live_threshold": f"WITH {o.POOLS} SELECT strftime(game_date,'%Y-%m-%d') game_date, pool, pool_key, kth FROM thr",
    "mart_diff": f"""WITH l AS (SELECT CAST(l_orderkey AS VARCHAR) game_id, strftime(DATE '2026-05-01' + CAST(l_orderkey%{DAYS} AS INT), '%Y-%m-%d') game_date,
        CASE WHEN l_linestatus='F' THEN 'home' ELSE 'away' END side, l_linenumber-1 pos_idx, l_partkey part, 'P'||l_suppkey "name",
        l_partkey%5 hit, (l_partkey+l_suppkey)%5 er, l_suppkey%3 bb, {o.pick(b.INNING_TEXTS, 'l_partkey+l_linenumber')} inn FROM lineitem),
      m AS (SELECT *, {o.outs_case('inn', o.OUTS_BY_TEXT)} a, {o.outs_case('inn', OUTS_SECOND)} z FROM l),
      k AS (SELECT *, a>0 OR hit+bb<>0 ka, z>0 OR hit+bb<>0 kz FROM m)
      SELECT game_date, game_id, side, pos_idx, part, "name", CASE WHEN NOT ka THEN 'added' WHEN NOT kz THEN 'removed' ELSE 'changed' END change,
        CASE WHEN ka AND kz THEN CASE WHEN (a>=18)<>(z>=18) THEN 'OUT,LONG' ELSE 'OUT' END ELSE '' END changed
      FROM k WHERE (ka AND kz AND a<>z) OR ka<>kz""",
    "landed_batters": f"""WITH {o.LINE_BATTERS} SELECT game_id, side, {_ROW_OF_SIDE.format("pos_idx, player_code, ab, subst, array_to_string(slots, '|')")} pos_idx, player_code, "name", pos,
      CAST(subst AS BIGINT) substitute_in, ab, hit, run, rbi, hr, bb, sb, CAST(0 AS BIGINT) hbp, kk, array_to_string(slots, '|') codes FROM lb""",
    "landed_pitchers": f"""SELECT CAST(l_orderkey AS VARCHAR) game_id, CASE WHEN l_linestatus='F' THEN 'home' ELSE 'away' END side,
      {_ROW_OF_SIDE.format("l_linenumber, l_partkey, 'P'||l_suppkey")} pos_idx, 'P'||l_suppkey "name", {o.pick(b.INNING_TEXTS, 'l_partkey+l_linenumber')} inn,
      l_partkey%5 hit, l_partkey%3 r, (l_partkey+l_suppkey)%5 er, CAST(l_partkey%17=0 AS BIGINT) hr, l_suppkey%3 bb,
      l_suppkey%3 + l_partkey%2 - CAST(l_partkey%10=0 AS INT) bbhp, l_partkey%8 kk, {o.pick(b.DECISIONS, 'l_partkey+l_suppkey')} wls FROM lineitem""",
    "landed_records": f"""WITH {o.LINE_RECORDS} SELECT game_id, row_number() OVER (PARTITION BY game_id ORDER BY idx, supp) - 1 idx, how,
      CASE WHEN how<>'홈런' THEN n1||'('||line||'회) '||n2||'('||(1+part%9)||'회)'
        WHEN line%2=0 THEN n1||'7호('||line||'회'||(1+supp%4)||'점 토다)'
        ELSE n1||'33호('||line||'회'||(1+part%4)||'점 토다) '||n2||'25호26호(6회'||(1+supp%4)||'점 8회1점 원 육)' END AS "result",
      strftime(DATE '2026-05-01' + CAST(CAST(game_id AS BIGINT)%{DAYS} AS INT), '%Y-%m-%d') info_date, {o.pick(TEAMS, 'CAST(game_id AS BIGINT)')} stadium,
      {o.pick(TEAMS, 'CAST(game_id AS BIGINT)+1')} info_home, {o.pick(TEAMS, 'CAST(game_id AS BIGINT)+2')} info_away FROM rec""",
    "landed_relay": f"""WITH {o.EV} SELECT game_id, no, row_number() OVER (PARTITION BY game_id, no ORDER BY sub) - 1 sub, inn, half, sub%3 "out",
      array_to_string(base, ',') base, hs home_score, as_ away_score, {_TEXT} "text" FROM rl""",
    "landed_relay_second": f"""WITH {o.EV} SELECT game_id, no, row_number() OVER w - 1 + count(*) FILTER (sub%5=0) OVER w sub, inn, half, {_TEXT} "text"
      FROM rl WINDOW w AS (PARTITION BY game_id, no ORDER BY sub)""",
    "rescored_days": """WITH r AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) d, CAST(o_orderkey AS VARCHAR) g, 'C'||o_custkey n, o_custkey%50 p FROM orders),
      s AS (SELECT d, g, n, CASE WHEN month(d)%3=0 THEN p ELSE p+1 END p FROM r WHERE month(d)<>6)
      SELECT 'kbo' league, strftime(days.d, '%Y-%m-%d') game_date, CAST(month(days.d)%2=0 OR month(days.d)%3=0 AS BIGINT) final, count(s.d) "rows",
        CAST(sum(p) AS BIGINT) lp, arg_max(n, (p, g)) top_name FROM (SELECT DISTINCT d FROM r) days LEFT JOIN s USING (d) GROUP BY days.d""",
}
