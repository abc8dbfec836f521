from datetime import date

from pyspark.sql import functions as F

from dugout.model import BOX_BATTERS, COST_LIST, TEAM_PITCHING
from dugout.operators import cost, positions as pos


def batter(game, side, idx, code, name, text):
    return (game, side, idx, code, name, text, False, 1, 0, 0, 0, 0, 0, 0, 0, 0, None)


def test_position_window(spark):
    games = spark.createDataFrame(
        [("g1", date(2026, 5, 1), 0, "RESULT", "LG", "KT"), ("g2", date(2026, 5, 2), 0, "RESULT", "SSG", "KT"),
         ("g3", date(2026, 5, 2), 1, "STARTED", "LG", "KT"), ("g0", date(2026, 4, 1), 0, "RESULT", "NC", "KT")],
        "game_id STRING, game_date DATE, game_seq INT, status_code STRING, home_team_name STRING, away_team_name STRING",
    )
    team = spark.createDataFrame([(g, s, "9") for g in ("g0", "g1", "g2", "g3") for s in ("home", "away")], TEAM_PITCHING)
    rows = spark.createDataFrame(
        [batter("g1", "home", 0, "1", "옛이름", "유"), batter("g2", "home", 0, "1", "새이름", "좌중"),
         batter("g0", "home", 0, "1", "너무옛", "포"), batter("g3", "home", 0, "1", "진행중", "포"),
         batter("g1", "away", 1, "2", "타자", "타"), batter("g2", "away", 1, "2", "타자", "지"),
         batter("g2", "away", 2, "", "코드없음", "유")],
        BOX_BATTERS,
    )
    table = pos.position_table(pos.position_window(rows, team, games, "2026-05-02"))
    got = {r.player_code: r for r in table.collect()}
    assert set(got) == {"1", "2"}
    assert (got["1"].name, got["1"].team, got["1"].games, got["1"].auto_position) == ("새이름", "LG", 2, "유격수")
    assert got["1"].innings_by_position == {"유격수": 9.0, "좌익수": 4.5, "중견수": 4.5}
    assert (got["2"].auto_position, got["2"].dh_games) == ("지명타자", 2)

    previous = spark.createDataFrame(
        [("1", "새이름", "LG", "유격수", "포수"), ("9", "부상", "KT", "좌익수", "우익수"), ("8", "떠남", "KT", "좌익수", None)],
        "player_code STRING, name STRING, team STRING, auto_position STRING, manual_position STRING",
    )
    merged = {r.player_code: r.effective_position for r in pos.merge_overrides(table, previous).collect()}
    assert merged == {"1": "포수", "2": "지명타자", "9": "우익수"}
    asked = spark.createDataFrame([("1", ""), ("77", "포수")], "player_code STRING, new_position STRING")
    out = pos.apply_overrides(pos.merge_overrides(table, previous), asked)
    assert {r.player_code: r.effective_position for r in out.collect()}["1"] == "유격수"
    assert [r.player_code for r in pos.rejected_overrides(table, asked).collect()] == ["77"]


def test_cost_tiers(spark):
    raw = spark.createDataFrame(
        [("", "SS", "김", "5"), ("LG7", "1B", "이", "3"), ("KT", "1B", "이", "4"), ("", "CF", "이", "9"),
         ("", "P", "박", "2"), ("", "SP", "최", "x"), ("", "ZZ", "정", "1"), ("", "C", "", "1")],
        COST_LIST,
    )
    costs = cost.read_costs(raw)
    rows = spark.createDataFrame(
        [("김", "LG", "유격수"), ("김", "LG", "포수"), ("이", "LG", "1루수"), ("이", "NC", "1루수"), ("이", "KT", "포수"),
         ("이", "NC", "중견수"), ("없음", "LG", "포수")],
        "name STRING, team STRING, position STRING",
    )
    got = [r.roster_cost for r in cost.attach_batter_cost(rows.coalesce(1), costs).orderBy("name", "position", "team").collect()]
    want = {("김", "유격수", "LG"): 5, ("김", "포수", "LG"): 5, ("이", "1루수", "LG"): 3, ("이", "1루수", "NC"): None,
            ("이", "포수", "KT"): 4, ("이", "중견수", "NC"): 9, ("없음", "포수", "LG"): None}
    assert got == [want[k] for k in sorted(want)]
    arms = cost.attach_pitcher_cost(spark.createDataFrame([("박", "LG"), ("최", "LG")], "name STRING, team STRING"), costs)
    assert {r["name"]: r.roster_cost for r in arms.collect()} == {"박": 2, "최": None}
    assert arms.filter(F.col("roster_cost").isNotNull()).count() == 1
