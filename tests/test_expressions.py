import pytest
from pyspark.sql import functions as F

from dugout.functions import innings, plate, records, relaytext as rt, rules, scoring
from dugout.functions.text import counter, strip


def values(spark, inputs, build):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i INT, v STRING")
    return [r.o for r in rows.select("i", build(F.col("v")).alias("o")).orderBy("i").collect()]


def test_plate_classes(spark):
    cases = {
        "삼진": "K", "4구": "BB", "사구": "HBP", "유병": "GDP", "유땅": "GO", "투희땅": "SACBUNT",
        "투희번": "SACBUNT", "1번": "BUNT_OUT", "중희비": "SACFLY", "좌파": "FO", "우비": "FO", "3직": "LD",
        "2실": "REACH_ERROR", "좌중홈": "HR", "2안": "1B", "3안": "1B", "좌중2": "2B", "우3": "3B", "xx": "1B",
    }
    assert values(spark, list(cases), plate.plate_class) == list(cases.values())


def test_slash_split(spark):
    rows = spark.createDataFrame([(["4구/4구", None, "", "좌파/유땅", "삼진"],)], "s ARRAY<STRING>")
    got = rows.select(plate.plate_classes(F.col("s")).alias("c")).first().c
    assert got == ["BB", "BB", "FO", "GO", "K"]


def test_innings(spark):
    cases = {"5 ⅔": 17, "⅓": 1, "5": 15, "": 0, " 6 ": 18, "4.4": 13, "junk": 0, "5⅓": 16, " 7 ": 21}
    assert values(spark, list(cases), innings.outs_from_fraction) == list(cases.values())
    assert values(spark, [None], innings.outs_from_fraction) == [0]
    cases = {"6.2": 20, "6": 18, "": 0, "0.1": 1, ".2": 2, "x": None}
    assert values(spark, list(cases), innings.outs_from_decimal) == list(cases.values())


def test_play_classes(spark):
    cases = {
        "유격수 플라이 실책으로 출루": "NONE", "자동 고의4구": "BB", "스트라이크 낫아웃 폭투": "K",
        "유격수 병살타": "GDP", "중견수 희생플라이 (중견수 실책)": "SACFLY", "투수 희생번트 아웃": "SACBUNT",
        "우월 홈런": "HR", "우중간 2루타": "2B", "내야안타": "1B", "번트 아웃": "NONE", "인필드 아웃": "GO",
        "3루수 라인드라이브 아웃": "LD", "몸에 맞는 볼": "HBP", "파울 플라이 아웃": "FO",
    }
    assert values(spark, list(cases), rt.play_class) == list(cases.values())


def test_line_kinds(spark):
    cases = {
        "3회말 LG 공격": "mark", "투수 김 : 투수 박 (으)로 교체": "sub", "1루주자 이 : 도루로 2루까지 진루": "steal",
        "3루주자 이 : 도루로 홈인": "steal", "2루주자 이 : 폭투로 홈인": "run",
        "1루주자 이 : 도루실패아웃 (포수->2루수 2루 태그아웃)": "caught",
        "1루주자 이 : 견제사아웃 (투수 견제 아웃)": "pickoff",
        "1루주자 이 : 포스아웃 (유격수->2루수 2루 터치아웃)": "runner_out", "이 : 볼넷": "play", "1구 볼": "other",
    }
    assert values(spark, list(cases), rt.line_kind) == list(cases.values())


def test_chains(spark):
    got = values(spark, ["땅볼 아웃 (유격수->2루수->1루수 송구아웃)", "플라이 아웃 (좌익수 포구아웃)", "삼진"], rt.play_chain)
    assert got == [["유격수", "2루수", "1루수"], None, None]
    lone = values(spark, ["1루주자 이 : 포스아웃 (2루수 2루 터치아웃)"], rt.runner_out_chain)
    assert lone == [["2루수"]]


def test_records(spark):
    text = "위즈덤33호(1회1점 가) 권희동25호26호(6회4점 8회1점 나 다)"
    assert values(spark, [text], records.grand_slam_names) == [["권희동"]]
    assert values(spark, [text, "강5호(3회4점 라)"], records.grand_slam_names_single) == [[], ["강"]]
    got = values(spark, ["가(3회) 나(12회)"], records.name_innings)[0]
    assert [(r.name, r.inn) for r in got] == [("가", 3), ("나", 12)]


def test_counters_and_blanks(spark):
    assert values(spark, ["", None, " 7 ", "x"], counter) == [0, 0, 7, None]
    assert values(spark, ["　가 나 ", "가"], strip) == ["가 나", "가"]


@pytest.mark.parametrize(
    "own, pos, mode, dh, want",
    [
        ("지명타자", "포수", 1, True, True), ("지명타자", "포수", 3, False, False), ("", "포수", 1, False, True),
        ("유격수", "2루수", 1, True, False), ("유격수", "2루수", 2, True, True), ("유격수", "좌익수", 2, True, False),
        ("유격수", "좌익수", 3, True, True),
    ],
)
def test_position_rule(spark, own, pos, mode, dh, want):
    row = spark.createDataFrame([(own, pos)], "own STRING, pos STRING")
    got = row.select(rules.position_allowed(F.col("pos"), F.col("own"), F.lit(mode), F.lit(dh)).alias("o"))
    assert got.first().o is want


def test_pregame_window(spark):
    now = F.to_timestamp(F.lit("2026-07-30 07:30:00"))
    got = values(spark, ["2026-07-30T18:30:00", "2026-07-30T18:31:00", "soon"], lambda c: rules.in_pregame_window(c, now))
    assert got == [True, False, False]


def test_bands_and_cost(spark):
    rows = spark.createDataFrame([(160, 4), (70, 0), (-5, None)], "lp INT, cost INT")
    got = rows.select(
        scoring.lp_band(F.col("lp")).alias("b"), scoring.cost_value(F.col("lp"), F.col("cost")).alias("v")
    ).collect()
    assert [(r.b, r.v) for r in got] == [("hot", 40.0), ("warm", None), ("cool", None)]
