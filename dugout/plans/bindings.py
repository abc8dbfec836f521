"""Domain inputs derived from the driver's tables.

The driver has no game logs, so each input of an operator is an expression over whole tables:
names, codes and numbers come from fixed lists indexed by the tables' own columns. The SQL in
``oracles.py`` derives the same inputs on its own.
"""

from __future__ import annotations

from collections.abc import Sequence
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dugout.model import DH, FIELD_POSITIONS, RELIEVER, ROSTER_FIELD_SLOTS, STARTER, TEAMS

PLATE_CODES = (
    "삼진", "4구", "사구", "유병", "유땅", "투희땅", "투희번", "1번", "중희비", "좌파",
    "우비", "3직", "2실", "좌중홈", "2안", "좌중2", "우3", "xx", "좌안", "중비",
)
POS_STRINGS = ("유", "좌중", "지", "포", "타", "一", "二三", "우주", "", "중")
DECISIONS = ("", "홀", "세", "블", "승", "패")
RECORD_WORDS = ("실책", "폭투", "도루자", "보크", "견제사", "홈런", "기타")
PLAYER_NAMES = ("가람", "나래", "다온", "라온", "마루", "바다", "사랑", "아라", "자람", "차온")
INNING_TEXTS = ("5 ⅔", "⅓", "6", "", "4.4", "abc", "7", "6 ⅓", "8", "9")
INNING_TEXTS_B = ("6.2", "6", "", "0.1", "7.0", "9")
COST_CODES = ("1B", "2B", "3B", "SS", "C", "LF", "CF", "RF", "DH", "SP", "P")
BOARD_POSITIONS = (*FIELD_POSITIONS, DH, "")
ROUNDS = ("kbo_r", "kbo_e", "kbo_ps_wd", "kbo_as", "kbo_ps_ks", "kbo_r")
TEAM_CODES = ("HT", "SS", "LG", "KT", "OB", "SK", "HH", "LT", "NC", "WO")
ROSTER_ROLES = ("투수", "포수", "내야수", "외야수", "감독")

# Play-by-play sentences; {b} batter, {r} runner, {f} incoming fielder, {p} incoming pitcher, {q} the
# pitcher leaving, {i} inning.
SENTENCES = (
    "{i}회초 원정 공격",
    "투수 {q} : 투수 {p} (으)로 교체",
    "유격수 {r} : 유격수 {f} (으)로 교체",
    "포수 {r} : 포수 {f} (으)로 교체",
    "대타 {r} : 2루수 {f} (으)로 교체",
    "1루주자 {r} : 도루로 2루까지 진루",
    "3루주자 {r} : 도루로 홈인",
    "3루주자 {r} : 홈인",
    "2루주자 {r} : 폭투로 홈인",
    "1루주자 {r} : 2루까지 진루",
    "1루주자 {r} : 도루실패아웃 (포수->2루수 2루 태그아웃)",
    "1루주자 {r} : 견제사아웃 (투수 견제 아웃)",
    "2루주자 {r} : 견제사아웃 (포수 견제 아웃)",
    "1루주자 {r} : 포스아웃 (유격수->2루수 2루 터치아웃)",
    "2루주자 {r} : 태그아웃 (중견수->포수 태그아웃)",
    "1루주자 {r} : 포스아웃 (2루수 2루 터치아웃)",
    "{b} : 좌익수 앞 1루타",
    "{b} : 우중간 2루타",
    "{b} : 중견수 뒤 3루타",
    "{b} : 좌월 홈런 (홈런거리:120M)",
    "{b} : 볼넷",
    "{b} : 자동 고의4구",
    "{b} : 몸에 맞는 볼",
    "{b} : 삼진 아웃",
    "{b} : 스트라이크 낫아웃 폭투",
    "{b} : 유격수 병살타 (유격수->2루수->1루수 송구아웃)",
    "{b} : 희생플라이 아웃 (중견수->포수 송구아웃)",
    "{b} : 투수 희생번트 아웃 (투수->1루수 송구아웃)",
    "{b} : 유격수 땅볼 아웃 (유격수->1루수 송구아웃)",
    "{b} : 3루수 라인드라이브 아웃 (3루수 포구아웃)",
    "{b} : 좌익수 플라이 아웃",
    "{b} : 번트 아웃 (포수->1루수 송구아웃)",
    "{b} : 2루수 앞 땅볼로 출루",
    "{b} : 유격수 플라이 실책으로 출루",
    "{b} : 3루수 삼중살 아웃 (3루수->2루수->1루수 송구아웃)",
    "1구 볼",
    "1루주자 {r} : 홈인",
    "투수 {p} : {q} (으)로 교체",
    "{b} : 좌익수 실책으로 출루",
)
# Box-score code of each sentence that is a plate appearance.
SENTENCE_CODES = {
    16: "좌안", 17: "우중2", 18: "중3", 19: "좌월홈", 20: "4구", 21: "4구", 22: "사구", 23: "삼진",
    24: "삼진", 25: "유병", 26: "중희비", 27: "투희번", 28: "유땅", 29: "3직", 30: "좌비", 31: "포땅",
    32: "유땅", 33: "유실", 34: "3땅",
}
FIELD_LETTERS = ("一", "二", "三", "유", "좌", "중", "우", "포", "지")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: Sequence[str], index: Column) -> Column:
    place = F.pmod(index, F.lit(len(values))).cast("int")
    listed = ", ".join("'" + v.replace("'", "\\'") + "'" for v in values)
    return F.element_at(F.expr(f"array({listed})"), place + 1)


def _int(value: Column) -> Column:
    return value.cast("int")


def computed(value: Column, name: str) -> Column:
    """A column the optimiser treats as stored: a filter on it does not repeat its expression."""
    return F.explode(F.array(value)).alias(name)


def line_batters(spark: SparkSession, sf_dir: str, by_game: bool = False) -> DataFrame:
    """One box-score batter line per lineitem row.

    With ``by_game`` also order, the number of the game, by which the lines are dealt out and sorted: as the few columns
    they are made of, so that the many made of them are neither moved nor sorted.
    """
    part, supp, line, order = (F.col(c) for c in ("l_partkey", "l_suppkey", "l_linenumber", "l_orderkey"))
    live = (part % 9 != 0)

    def number(value: Column) -> Column:
        return F.when(live, _int(value)).otherwise(0)

    code = pick(PLATE_CODES, part)
    rows = table(spark, sf_dir, "lineitem")
    if by_game:
        rows = rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_linestatus", "l_returnflag")
        rows = rows.repartition("l_orderkey").sortWithinPartitions("l_orderkey")
    return rows.select(
        *([order.alias("order")] if by_game else []),
        order.cast("string").alias("game_id"), part.alias("part"), line.alias("line"),
        F.when(F.col("l_linestatus") == "F", "home").otherwise("away").alias("side"),
        (part * 8 + line).alias("pos_idx"), supp.cast("string").alias("player_code"),
        F.concat(F.lit("P"), supp.cast("string")).alias("name"),
        F.when(live, pick(POS_STRINGS, part)).otherwise("").alias("pos"),
        ((F.col("l_returnflag") == "R") & live).alias("substitute_in"),
        number(F.col("l_quantity").cast("bigint") % 5).alias("ab"), number(part % 4).alias("hit"),
        number(supp % 3).alias("run"), number(line % 3).alias("rbi"),
        number((part % 11 == 0).cast("int")).alias("hr"), number((part + line) % 3).alias("bb"),
        number((supp + line) % 4).alias("kk"), number((part % 13 == 0).cast("int")).alias("sb"),
        F.array(
            F.when(part % 7 == 0, F.concat(code, F.lit("/"), pick(PLATE_CODES, part * 7 + line))).otherwise(code),
            F.when(line % 3 != 0, pick(PLATE_CODES, supp + line)),
            F.when(F.col("l_quantity") > 40, "").otherwise(pick(PLATE_CODES, order + supp)),
            F.when(line % 2 == 0, pick(PLATE_CODES, F.lit(14) + part % 4)),
        ).alias("pa_codes"),
    )


def line_pitchers(spark: SparkSession, sf_dir: str, second: bool = False) -> DataFrame:
    """One box-score pitcher line per lineitem row."""
    part, supp, line, order = (F.col(c) for c in ("l_partkey", "l_suppkey", "l_linenumber", "l_orderkey"))
    texts = INNING_TEXTS_B if second else INNING_TEXTS
    return table(spark, sf_dir, "lineitem").select(
        order.cast("string").alias("game_id"), part.alias("part"), line.alias("line"),
        F.when(F.col("l_linestatus") == "F", "home").otherwise("away").alias("side"),
        (line - 1).alias("pos_idx"), F.concat(F.lit("P"), supp.cast("string")).alias("name"),
        computed(pick(texts, part + line), "inn"),
        _int(part % 5).alias("hit"), _int(part % 3).alias("r"), _int((part + supp) % 5).alias("er"),
        _int((part % 17 == 0).cast("int")).alias("hr"), _int(supp % 3).alias("bb"),
        _int(supp % 3 + part % 2 - (part % 10 == 0).cast("int")).alias("bbhp"), _int(part % 8).alias("kk"),
        pick(DECISIONS, part + supp).alias("wls"),
    )


def line_team_pitching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Team innings text: the longest outing of the side."""
    rows = line_pitchers(spark, sf_dir)
    return rows.groupBy("game_id", "side").agg(
        F.max(F.when(F.col("inn").rlike(r"^\d$"), F.col("inn")).otherwise("0")).alias("inn")
    )


def order_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One game per order."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    status = F.when(F.col("o_orderstatus") == "F", "RESULT").when(
        F.col("o_orderstatus") == "O", F.when(cust % 2 == 0, "BEFORE").otherwise("READY")
    ).otherwise("STARTED")
    hour = F.lpad((F.lit(13) + cust % 6).cast("string"), 2, "0")
    return table(spark, sf_dir, "orders").select(
        key.cast("string").alias("game_id"), F.lit("kbo").alias("league"),
        F.to_date("o_orderdate").alias("game_date"),
        F.concat(
            F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T"), hour, F.lit(":30:00")
        ).alias("game_datetime"),
        status.alias("status_code"), (cust % 17 == 0).alias("cancel"),
        pick(TEAM_CODES, cust).alias("home_team_code"), pick(TEAM_CODES, cust + 3).alias("away_team_code"),
        pick(TEAMS, cust).alias("home_team_name"), pick(TEAMS, cust + 3).alias("away_team_name"),
        pick(ROUNDS, key).alias("round_code"), key.alias("game_seq"),
    )


def line_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Special-record strings; two players a record."""
    part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    first, second = pick(PLAYER_NAMES, supp), pick(PLAYER_NAMES, part)
    how = pick(RECORD_WORDS, part)
    homers = F.concat(
        first, F.lit("33호("), line.cast("string"), F.lit("회"), (F.lit(1) + part % 4).cast("string"),
        F.lit("점 토다) "), second, F.lit("25호26호(6회"), (F.lit(1) + supp % 4).cast("string"),
        F.lit("점 8회1점 원 육)"),
    )
    alone = F.concat(
        first, F.lit("7호("), line.cast("string"), F.lit("회"), (F.lit(1) + supp % 4).cast("string"),
        F.lit("점 토다)"),
    )
    plain = F.concat(
        first, F.lit("("), line.cast("string"), F.lit("회) "), second, F.lit("("),
        (F.lit(1) + part % 9).cast("string"), F.lit("회)"),
    )
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("game_id"),
        (part * 8 + line).alias("idx"), supp.alias("supp"), how.alias("how"),
        F.when(how == "홈런", F.when(line % 2 == 0, alone).otherwise(homers)).otherwise(plain).alias("result"),
    )


def event_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers every play-by-play binding builds on."""
    k = F.get_json_object("props", "$.k").cast("int")
    event = F.col("event_id")
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", computed(k, "k"))
    k = F.col("k")
    return events.select(
        F.col("user_id").cast("string").alias("game_id"), "event_id", "ts", "k",
        F.expr("event_id div 400").cast("int").alias("no"), event.cast("int").alias("sub"),
        (F.expr("event_id div 1200") % 9 + 1).cast("int").alias("inn"),
        (F.expr("event_id div 400") % 2).cast("string").alias("half"),
        F.pmod(event * 7 + k * 11, F.lit(len(SENTENCES))).cast("int").alias("t"),
    ).withColumns(
        {
            "bat_side": F.when(F.col("half") == "0", "V").otherwise("H"),
            "field_side": F.when(F.col("half") == "0", "H").otherwise("V"),
        }
    )


def relay_events(spark: SparkSession, sf_dir: str, extra: Sequence[str] = ()) -> DataFrame:
    """Play-by-play lines: one per event."""
    k = F.col("k")
    names = {
        "i": F.col("inn").cast("string"),
        "b": F.concat("bat_side", (k % 9 + 1).cast("string")),
        "r": F.concat("bat_side", (F.expr("k div 9") % 9 + 1).cast("string")),
        "f": F.concat("field_side", (k % 9 + 1).cast("string")),
        "p": F.concat("field_side", F.lit("P"), (k % 4).cast("string")),
        "q": F.concat("field_side", F.lit("P"), (F.expr("k div 4") % 4).cast("string")),
    }
    # A sentence is text, a name, text, perhaps another name, text.
    pieces = [(re.split(r"\{(\w)\}", sentence) + [""] * 4)[:5] for sentence in SENTENCES]

    def piece(n: int) -> Column:
        return pick([p[n] for p in pieces], F.col("t"))

    def name(n: int) -> Column:
        which, out = piece(n), F.lit("")
        for mark, value in names.items():
            out = F.when(which == mark, value).otherwise(out)
        return out

    text = F.concat(piece(0), name(1), piece(2), name(3), piece(4))
    return event_fields(spark, sf_dir).select(
        "game_id", "no", "sub", "inn", "half", (F.col("sub") % 3).alias("out"),
        F.array(
            (k % 10).cast("string"), F.expr("k div 10").cast("string"), ((k * 7 + 3) % 10).cast("string")
        ).alias("base"),
        F.expr("event_id div 700").cast("int").alias("home_score"),
        (F.expr("event_id div 900") + k % 5).cast("int").alias("away_score"),
        *extra, computed(text, "text"),
    )


def relay_box_batters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box score of the same games: one row per (game, side, batter), class counts included."""
    from dugout.functions import plate

    t = F.col("t")
    code = None
    for number, value in SENTENCE_CODES.items():
        code = F.when(t == number, value) if code is None else code.when(t == number, value)
    # The class names its code in every branch, so the code is stored first: spelled out there it makes a method too long to compile.
    plays = event_fields(spark, sf_dir).select("*", computed(code, "code")).withColumns(
        {"n": (F.col("k") % 9).cast("int"), "class": plate.plate_class(F.col("code"))}
    )

    def count(condition: Column) -> Column:
        return F.count_if(F.coalesce(condition, F.lit(False))).cast("int")

    kind = F.col("class")
    rows = plays.groupBy("game_id", "half", "bat_side", "n").agg(
        count(F.col("code").isNotNull()).alias("ab"), count(t.between(16, 19)).alias("hit"),
        count(t == 7).alias("run"), count(t == 36).alias("rbi"), count(t == 19).alias("hr"),
        count(t.isin(20, 21)).alias("bb"), count(t.isin(23, 24)).alias("kk"), count(t == 5).alias("sb"),
        *[count(kind == c).alias(f"pa_{c}") for c in plate.PLATE_CLASSES],
    )
    return rows.select(
        "game_id", F.when(F.col("half") == "0", "away").otherwise("home").alias("side"),
        F.col("n").alias("pos_idx"),
        F.concat("bat_side", (F.col("n") + 1).cast("string")).alias("name"),
        F.concat("game_id", F.lit("-"), "bat_side", (F.col("n") + 1).cast("string")).alias("player_code"),
        pick(FIELD_LETTERS, F.col("n")).alias("pos"), F.lit(False).alias("substitute_in"),
        "ab", "hit", "run", "rbi", "hr", "bb", "kk", "sb",
        *[f"pa_{c}" for c in plate.PLATE_CLASSES],
    )


def relay_box_pitchers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitchers of the same games: four names a side."""
    t = F.col("t")
    rows = (
        event_fields(spark, sf_dir).withColumn("j", (F.col("k") % 4).cast("int"))
        .groupBy("game_id", "half", "field_side", "j")
        .agg(
            F.count(F.lit(1)).cast("int").alias("lines"), F.count_if(t.between(16, 19)).cast("int").alias("hit"),
            F.count_if(t.isin(6, 7, 8, 19, 36)).cast("int").alias("r"),
            F.count_if(t.isin(7, 19)).cast("int").alias("er"), F.count_if(t == 19).cast("int").alias("hr"),
            F.count_if(t.isin(20, 21)).cast("int").alias("bb"),
            F.count_if(t.isin(20, 21, 22)).cast("int").alias("bbhp"),
            F.count_if(t.isin(23, 24)).cast("int").alias("kk"),
        )
    )
    return rows.select(
        "game_id", F.when(F.col("half") == "0", "home").otherwise("away").alias("side"),
        F.col("j").alias("pos_idx"), F.concat("field_side", F.lit("P"), F.col("j").cast("string")).alias("name"),
        (F.col("lines") % 8).cast("string").alias("inn"), "hit", "r", "er", "hr", "bb", "bbhp", "kk",
        pick(("", "홀", "세", "블"), F.col("j")).alias("wls"),
    )


def relay_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finished game per user."""
    user = F.col("user_id")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.to_date(F.min("ts")).alias("game_date")
    ).select(
        user.cast("string").alias("game_id"), F.lit("kbo").alias("league"), "game_date",
        F.when(user % 4 == 0, "STARTED").otherwise("RESULT").alias("status_code"),
        pick(TEAMS, user).alias("home_team_name"), pick(TEAMS, user + 3).alias("away_team_name"),
    )


def relay_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error records of the same games."""
    return event_fields(spark, sf_dir).filter(F.col("t") == 33).select(
        "game_id", F.col("sub").alias("idx"), F.lit("실책").alias("how"),
        F.concat(
            "field_side", (F.col("k") % 9 + 1).cast("string"), F.lit("("), F.col("inn").cast("string"),
            F.lit("회)"),
        ).alias("result"),
    )


def cost_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw cost rows, bad ones included."""
    part, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.when(size % 3 == 0, "").otherwise(F.concat(pick(TEAMS, size), F.lit("7"))).alias("hint"),
        F.when(part % 13 == 0, "XX").otherwise(pick(COST_CODES, part)).alias("position"),
        F.concat(F.lit("N"), (part * part % 3001).cast("string")).alias("name"),
        F.when(part % 17 == 0, "x").otherwise((F.lit(1) + size % 5).cast("string")).alias("cost"),
    )


def cost_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players looking for a cost."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("N"), (F.col("l_partkey") % 3001).cast("string")).alias("name"),
        pick(TEAMS, F.col("l_suppkey")).alias("team"),
        pick((*FIELD_POSITIONS, DH), F.col("l_linenumber")).alias("position"),
    )


def roster_pool(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Batters and pitchers of every brand, which stands for a day."""
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("game_date"), key.cast("string").alias("player"),
        (key * 37 % 161 - 20).cast("int").alias("lp"), (F.expr("p_partkey div 7") % 5 + 1).cast("int").alias("roster_cost"),
        (key % 3 == 2).alias("arm"), pick((*ROSTER_FIELD_SLOTS, DH), F.col("p_size")).alias("position"),
        F.when(key % 2 == 0, STARTER).otherwise(RELIEVER).alias("role"),
    )
    return rows.filter(~F.col("arm")).drop("arm", "role"), rows.filter("arm").drop("arm", "position")


def board_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows of both kinds; a month stands for a day."""
    cust, key, priority = F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderpriority")
    role = F.when(priority == "1-URGENT", STARTER).when(priority == "2-HIGH", RELIEVER)
    return table(spark, sf_dir, "orders").select(
        F.to_date(F.date_trunc("month", "o_orderdate")).alias("game_date"), key.alias("row_id"),
        F.concat(F.lit("C"), cust.cast("string")).alias("name"), pick(TEAMS, cust).alias("team"),
        pick(TEAMS, cust + 1 + key % 3).alias("opponent"),
        (F.col("o_totalprice").cast("bigint") % 300 - 50).cast("int").alias("lp"),
        F.when(role.isNotNull(), "pitcher").otherwise("batter").alias("kind"), role.alias("role"),
        F.when(role.isNull(), pick(BOARD_POSITIONS, key)).alias("position"),
        F.when(key % 7 != 0, (key % 6).cast("int")).alias("roster_cost"),
    )


def active_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active players per team and day."""
    part = F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        pick(TEAM_CODES, F.col("l_suppkey")).alias("team_code"), F.to_date("l_shipdate").alias("game_date"),
        F.concat(F.lit("N"), (part % 20).cast("string")).alias("name"),
        pick(ROSTER_ROLES[:4], part).alias("category"), part.alias("p"),
    ).groupBy("team_code", "game_date", "name").agg(F.max_by("category", "p").alias("category"))


def announced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announced lineups per game."""
    return table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_orderkey").cast("string").alias("game_id"),
        F.when(F.col("l_linestatus") == "F", "home").otherwise("away").alias("side"),
        F.concat(F.lit("N"), (F.col("l_partkey") % 20).cast("string")).alias("name"),
    ).agg(
        F.max("l_linenumber").cast("int").alias("bat_order"),
        F.max(F.col("l_returnflag") == "R").alias("is_starting_pitcher"),
    )


def known_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.lpad(key.cast("string"), 12, "0").alias("player_code"),
        F.concat(F.lit("N"), (key % 20).cast("string")).alias("name"), pick(TEAMS, F.expr("s_suppkey div 3")).alias("team"),
        pick((*FIELD_POSITIONS, DH), key).alias("effective_position"),
    )


def roster_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roster pages: the links of a web page dressed as one roster table."""
    page = F.col("page_id")
    links = F.regexp_replace("html", '<a href="[^"]*">', '<a href="/p?playerId=1">')
    return table(spark, sf_dir, "pages").select(
        pick(TEAM_CODES, page).alias("team_code"),
        F.date_add(F.lit("2026-05-01").cast("date"), (page % 30).cast("int")).alias("game_date"),
        F.concat(
            F.lit("<h3>선수등록명단</h3><table class=\"tNData\"><tr><th>번호</th> <th>"), pick(ROSTER_ROLES, page),
            F.lit("</th></tr>"), links, F.lit("</table><h3>등/말소 현황</h3>"), links,
        ).alias("html"),
    )


