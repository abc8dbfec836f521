import json
import os

import pytest
from pyspark.sql import functions as F

from dugout.model import POSITIONS
from dugout.operators import cost, merge
from dugout.plans import jobs
from dugout.sources import landed, published, sinks, staging, tables

DAY = "2026-05-05"


def write(path, doc):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(doc, f, ensure_ascii=False)


def line(text, out="0", bases=("", "", ""), home="0", away="0"):
    state = {"out": out, "base1": bases[0], "base2": bases[1], "base3": bases[2], "homeScore": home, "awayScore": away}
    return {"text": text, "currentGameState": state}


def man(code, name, pos, **box):
    return {"playerCode": code, "name": name, "pos": pos, "ab": "4", **box}


@pytest.fixture()
def landing(tmp_path):
    root = str(tmp_path / "landing")
    games = [
        {"gameId": g, "statusCode": s, "gameDateTime": f"{DAY}T18:30:00", "gameDate": DAY, "homeTeamCode": "LG",
         "awayTeamCode": "KT", "homeTeamName": "LG", "awayTeamName": "KT", "roundCode": "kbo_r", "cancel": False}
        for g, s in (("G1", "RESULT"), ("G2", "STARTED"), ("G3", "BEFORE"))
    ]
    write(f"{root}/kbo/schedule/game_date={DAY}/{DAY}.json", {"result": {"games": games}})
    home = [man("1", "유격", "유", hit=2, run=1, inn1="좌안", inn2="좌중홈", hr="1", rbi=2), man("2", "일루", "一", kk=1, inn1="삼진")]
    away = [man("3", "타자", "중", inn1="유땅", hit=None), man("4", "대주", "")]
    away[1]["ab"] = "0"
    record = {
        "gameInfo": {"gdate": "20260505", "stadium": "잠실", "hName": "LG", "aName": "KT"},
        "battersBoxscore": {"home": home, "away": away},
        "pitchersBoxscore": {
            "home": [{"name": "선발", "inn": "9", "hit": 0, "r": 0, "er": 0, "kk": 10, "bb": 0, "bbhp": 0, "wls": "승"}],
            "away": [{"name": "원정", "inn": "8", "hit": 2, "r": 1, "er": 1, "hr": 1, "bb": 0, "bbhp": 1, "wls": "패"}],
        },
        "teamPitchingBoxscore": {"home": {"inn": "9"}, "away": {"inn": "8"}},
        "etcRecords": [{"how": "홈런", "result": "유격3호(3회4점 원정)"}, {"how": "실책", "result": "일루(2회)"}],
    }
    write(f"{root}/kbo/record/game_date={DAY}/G1.json", {"result": {"recordData": record}})
    broken = json.loads(json.dumps(record))
    broken["battersBoxscore"]["home"][0]["hit"] = "two"
    write(f"{root}/kbo/record/game_date={DAY}/G2.json", {"result": {"recordData": broken}})
    groups = [
        {"no": 1, "homeOrAway": "0", "textOptions": [line("1회초 KT 공격"), line("타자 : 유격수 땅볼 아웃 (유격수->1루수 송구아웃)", "1")]},
        {"no": 2, "homeOrAway": "1", "textOptions": [line("유격 : 좌월 홈런", "0", home="1")]},
    ]
    write(f"{root}/kbo/relay/game_date={DAY}/G1_1.json", {"result": {"textRelayData": {"textRelays": groups}}})
    late = [{"no": 9, "homeOrAway": "0", "textOptions": [line("타자 : 볼넷")]}]
    write(f"{root}/kbo/relay/game_date={DAY}/G1_3.json", {"result": {"textRelayData": {"textRelays": late}}})
    return root


def test_score_a_day(spark, landing, tmp_path):
    mart = str(tmp_path / "mart")
    positions = spark.createDataFrame([("1", "유격", "LG", {}, 3, "유격수", None, "유격수")], POSITIONS)
    costs = cost.read_costs(spark.createDataFrame([("", "SS", "유격", "5")], "hint STRING, position STRING, name STRING, cost STRING"))
    jobs.score_days(spark, landing, mart, "kbo", [DAY], positions, costs)
    batters = {r["name"]: r for r in published.read(spark, mart, "batters").collect()}
    assert set(batters) == {"유격", "일루", "타자"}  # nobody without an appearance, no broken game
    star = batters["유격"]
    # R15 + H20 + HR80 + RBI50 + grand slam 10 + assist 1
    assert (star.lp, star.roster_cost, star.position, star.team, star.stadium) == (176, 5, "유격수", "LG", "잠실")
    assert batters["일루"].lp == -25 and batters["타자"].lp == -10
    pitchers = {r["name"]: r for r in published.read(spark, mart, "pitchers").collect()}
    ace = pitchers["선발"]
    assert ace.PERFECT and ace.SHO and ace.QSPLUS and ace.lp == 270 + 150 + 30 + 100 + 30
    assert pitchers["원정"].HBP == 1 and not pitchers["원정"].QS  # 24 outs, one earned run: QS+
    ledger = published.read(spark, mart, "ledger")
    sums = {(r["name"], r.role): r.s for r in ledger.groupBy("name", "role").agg(F.sum("points").alias("s")).collect()}
    for rows, role in ((batters, "bat"), (pitchers, "pitch")):
        assert all(sums.get((n, role), 0) == r.lp for n, r in rows.items())
    gaps = published.read(spark, mart, "gaps").collect()
    assert [(r.game_id, r.first_missing, r.last_missing, str(r.game_date)) for r in gaps] == [("G1", 2, 2, DAY)]
    slam = ledger.filter(F.col("tag") == "GRANDSLAM").first()
    assert slam.inn == 1
    assert [r.game_id for r in published.read(spark, mart, "quarantine").collect()] == ["G2"]
    # One game is on and one has not begun: the day is scored again, until all are over.
    assert [r.final for r in published.pointers(spark, mart).collect()] == [False]
    tagged = merge.ledger_tags(ledger).filter(F.col("tag") == "PLAY:HR").first()
    assert tagged.tags == {"H": 1, "HR": 1}
    quality = {r.role: r.players for r in jobs.ledger_quality(ledger).collect()}
    assert quality["bat"] == 3
    rate = jobs.backfill_costs(spark, mart, costs, str(tmp_path / "costed")).first()
    assert (rate.matched, rate.total) == (1, 5)
    assert sinks.date_index(published.read(spark, mart, "batters")).first().games == 1


def shown(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_documents_are_parsed_once(spark, landing, tmp_path, monkeypatch):
    """Only new and changed files are read as JSON, one relation a kind; what is gone or was never finished is not seen."""
    from pyspark.sql.readwriter import DataFrameReader

    stage, reads, real = str(tmp_path / "stage"), [], DataFrameReader.json

    def json_(self, path, *rest, **more):
        reads.append(path)
        return real(self, path, *rest, **more)

    monkeypatch.setattr(DataFrameReader, "json", json_)

    def source():
        return jobs._landing(lambda kind: staging.documents(spark, stage, "kbo", kind, [DAY]), "kbo")

    assert staging.refresh(spark, landing, stage, "kbo", [DAY]) == {"schedule": [DAY], "record": [DAY], "relay": [DAY]}
    assert [len(x) for x in reads] == [1, 2, 2]  # one relation a kind, of its files
    staged, direct = source(), jobs.read_landing(spark, landing, "kbo", [DAY])
    reads.clear()
    for table in ("games", "batters", "pitchers", "relay", "gaps", "team_pitching", "etc_records", "info"):
        assert shown(getattr(staged, table)) == shown(getattr(direct, table)), table
    assert "json" not in staged.relay._jdf.queryExecution().toString().lower().replace("jsonto", "")
    assert staging.refresh(spark, landing, stage, "kbo", [DAY]) == {} and reads == []
    # Another day, a corrected inning, one that is gone.
    game = {"result": {"games": [{"gameId": "G7", "statusCode": "RESULT", "gameDate": "2026-05-06"}]}}
    write(f"{landing}/kbo/schedule/game_date=2026-05-06/d.json", game)
    groups = [{"no": 1, "homeOrAway": "0", "textOptions": [line("타자 : 볼넷"), line("1구 볼")]}]
    write(f"{landing}/kbo/relay/game_date={DAY}/G1_1.json", {"result": {"textRelayData": {"textRelays": groups}}})
    os.remove(f"{landing}/kbo/relay/game_date={DAY}/G1_3.json")
    assert staging.refresh(spark, landing, stage, "kbo", [DAY]) == {"relay": [DAY]}
    assert [[os.path.basename(x) for x in files] for files in reads] == [["G1_1.json"]]
    assert [(r.inn, r.text) for r in source().relay.orderBy("no", "sub").collect()] == [(1, "타자 : 볼넷"), (1, "1구 볼")]
    # A run that is lost before its manifest leaves what was there.
    write(f"{landing}/kbo/record/game_date={DAY}/G2.json", {"result": {}})
    before = shown(source().batters)
    create = spark.createDataFrame
    monkeypatch.setattr(spark, "createDataFrame", lambda rows, *more: 1 / 0 if rows else create(rows, *more))
    with pytest.raises(ZeroDivisionError):
        staging.refresh(spark, landing, stage, "kbo", [DAY])
    monkeypatch.setattr(spark, "createDataFrame", create)
    assert shown(source().batters) == before
    assert staging.refresh(spark, landing, stage, "kbo", [DAY]) == {"record": [DAY]}
    assert {r.game_id for r in source().batters.collect()} == {"G1"}


def test_days_are_published_whole(spark, landing, tmp_path, monkeypatch):
    """A job that is lost between writing and publishing leaves the day as it was; the next one moves all tables at once."""
    mart = str(tmp_path / "mart")
    positions = spark.createDataFrame([], POSITIONS)
    costs = cost.read_costs(spark.createDataFrame([], "hint STRING, position STRING, name STRING, cost STRING"))
    tables_ = ("batters", "pitchers", "ledger", "position_events", "quarantine", "gaps")
    jobs.score_days(spark, landing, mart, "kbo", [DAY], positions, costs)
    before = {t: shown(published.read(spark, mart, t)) for t in tables_}
    assert all(before.values())
    path = f"{landing}/kbo/record/game_date={DAY}/G1.json"
    with open(path, encoding="utf-8") as f:
        record = json.load(f)
    record["result"]["recordData"]["battersBoxscore"]["home"][0]["hit"] = 3
    write(path, record)
    real = published.publish
    monkeypatch.setattr(published, "publish", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        jobs.score_days(spark, landing, mart, "kbo", [DAY], positions, costs)
    assert {t: shown(published.read(spark, mart, t)) for t in tables_} == before
    monkeypatch.setattr(published, "publish", real)
    os.remove(f"{landing}/kbo/record/game_date={DAY}/G2.json")
    schedule = f"{landing}/kbo/schedule/game_date={DAY}/{DAY}.json"
    with open(schedule, encoding="utf-8") as f:
        games = json.load(f)
    games["result"]["games"][1]["statusCode"], games["result"]["games"][2]["cancel"] = "RESULT", True
    write(schedule, games)
    # The day was published with unfinished games, so a backfill takes it again, and once it is final no more.
    assert jobs.backfill_range(spark, landing, mart, DAY, DAY, positions, costs) == [DAY]
    assert {r["name"]: r.H for r in published.read(spark, mart, "batters").collect()}["유격"] == 3
    assert published.read(spark, mart, "quarantine").count() == 0
    assert jobs.backfill_range(spark, landing, mart, DAY, DAY, positions, costs) == []
    assert published.superseded(spark, mart).count() == 1


def test_pregame_rows_in_the_day(spark, landing, tmp_path):
    mart = str(tmp_path / "mart")
    positions = spark.createDataFrame([("1", "내", "LG", {}, 3, "2루수", None, "2루수")], POSITIONS)
    costs = cost.read_costs(spark.createDataFrame([], "hint STRING, position STRING, name STRING, cost STRING"))
    roster = spark.createDataFrame([("LG", "내", "내야수"), ("LG", "투", "투수"), ("KT", "외", "외야수")], "team_code STRING, name STRING, category STRING")
    roster = roster.withColumn("game_date", F.to_date(F.lit(DAY)))
    lineup = {"fullLineUp": [{"playerName": "투", "positionName": "선발투수"}, {"playerName": "내", "positionName": "2루수", "batorder": 3}]}
    write(f"{landing}/kbo/preview/game_date={DAY}/G3.json", {"result": {"previewData": {"gameInfo": {"stadium": "수원"}, "homeTeamLineUp": lineup}}})
    jobs.score_days(spark, landing, mart, "kbo", [DAY], positions, costs, roster=roster, now=f"{DAY} 08:00:00")
    rows = {r["name"]: r for r in published.read(spark, mart, "batters").where("game_id = 'G3'").collect()}
    assert {n: (r.position, r.bat_order, r.status, r.stadium, r.lp, r.roster_cost) for n, r in rows.items()} == {
        "내": ("2루수", 3, "pregame", "수원", 0, None), "외": ("외야수", None, "pregame", "수원", 0, None)}
    arms = published.read(spark, mart, "pitchers").where("game_id = 'G3'").collect()
    assert [(r["name"], r.role, r.stadium) for r in arms] == [("투", "선발", "수원")]
    assert published.read(spark, mart, "batters").where("game_id = 'G1'").count() == 3


def test_landed_innings(spark, landing):
    """Every landed inning is read, and those after a gap or a number are left out only if that is asked for."""
    def innings(**rule):
        return {r.inn for r in landed.read_relay(spark, f"{landing}/kbo/relay", **rule).collect()}

    last = [{"no": 90, "homeOrAway": "0", "textOptions": [line("타자 : 볼넷")]}]
    write(f"{landing}/kbo/relay/game_date={DAY}/G1_18.json", {"result": {"textRelayData": {"textRelays": last}}})
    write(f"{landing}/kbo/relay/game_date={DAY}/G1_2.json", {"result": {"textRelayData": {"textRelays": []}}})
    assert innings() == {1, 3, 18}
    assert innings(stop_at_gap=True) == {1} and innings(most=15) == {1, 3} and innings(stop_at_gap=True, most=15) == {1}
    gaps = landed.relay_gaps(spark, f"{landing}/kbo/relay").orderBy("first_missing").collect()
    assert [tuple(r) for r in gaps] == [("G1", 2, 2), ("G1", 4, 17)]


def test_box_slots_and_sides(spark, tmp_path):
    """Slots go by number without a last one; a side that is missing takes nothing from the other."""
    rows = [man("1", "김", "유", inn30="삼진", inn2="좌안", inn10="중비", innings="x", substituteIn=True)]
    box = {"gameInfo": {"gdate": "20260505"}, "battersBoxscore": {"away": rows}}
    write(str(tmp_path / "G1.json"), {"result": {"recordData": box}})
    row = landed.batters(landed.read_records(spark, str(tmp_path))).collect()
    assert [(r.side, r.pos_idx, r.pa_codes, r.ab, r.hit, r.substitute_in) for r in row] == [("away", 0, ["좌안", "중비", "삼진"], 4, 0, True)]


def test_broken_games(spark):
    """Junk innings text breaks a game of the second league only, junk hit-by-pitch likewise."""
    bat = "game_id string, ab int, hit int, run int, rbi int, hr int, bb int, kk int, sb int, hbp int"
    arm = "game_id string, inn string, hit int, r int, er int, hr int, bb int, bbhp int, kk int"
    hitters = spark.createDataFrame([("H", *[0] * 8, None), ("A", *[0] * 9)], bat)
    arms = spark.createDataFrame([("I", "five", *[0] * 7), ("A", "6.2", *[0] * 7), ("N", None, *[0] * 7)], arm)
    found = {league: {r.game_id for r in landed.broken_games(hitters, arms, league).collect()} for league in ("kbo", "mlb")}
    assert found == {"kbo": set(), "mlb": {"H", "I"}}


def test_second_league(spark, tmp_path):
    root, mart = str(tmp_path / "landing"), str(tmp_path / "mart")
    game = {"gameId": "M1", "statusCode": "RESULT", "gameDate": DAY, "homeTeamName": "뉴욕", "awayTeamName": "보스턴"}
    write(f"{root}/mlb/schedule/game_date={DAY}/d.json", {"result": {"games": [game]}})
    record = {
        "homeBatter": [{"name": "가", "posName": "유격수", "ab": 4, "hit": 3, "hr": 1, "so": 1}],
        "awayBatter": [{"name": "나", "posName": "좌익수", "ab": 3, "hbp": 1}],
        "homePitcher": [{"name": "투수1", "inn": "7.0", "er": 3, "hit": 5, "so": 4}, {"name": "투수2", "inn": "2.0"}],
        "awayPitcher": [{"name": "투수3", "inn": "8.0", "hit": 3, "r": 0, "er": 0, "bb": 1}],
    }
    write(f"{root}/mlb/record/game_date={DAY}/M1.json", {"result": {"recordData": record}})
    text = "<br/>가 : 우중간 2루타<br/> <br/>나 : 유격수 땅볼 아웃<br/>1루주자 다 : 2루까지 진루"
    groups = [
        {"no": 1, "inn": 1, "homeOrAway": "1", "text": text},
        {"no": 2, "inn": 1, "homeOrAway": "1", "text": "가 : 중견수 3루타<br/>3루주자 가 : 좌익수 실책"},
        {"no": 3, "inn": 2, "homeOrAway": "0", "text": "투수 투수1 : 투수2 (으)로 교체<br/>1루주자 나 : 도루로 2루까지 진루"},
    ]
    write(f"{root}/mlb/relay/game_date={DAY}/M1_1.json", {"result": {"textRelayData": {"textRelays": groups}}})
    jobs.score_days(spark, root, mart, "mlb", [DAY])
    rows = {r["name"]: r for r in published.read(spark, mart, "batters").collect()}
    # singles: 3 hits - double - triple - homer = 0, so no cycle
    assert (rows["가"]["2B"], rows["가"]["3B"], rows["가"].CYCLE) == (1, 1, False)
    assert rows["나"].SACBUNT == 1 and rows["나"].E == 1 and rows["나"].lp == 10 + 5 - 10
    arms = {r["name"]: r for r in published.read(spark, mart, "pitchers").collect()}
    assert arms["투수1"].QSPLUS and arms["투수2"].SB_ALLOWED == 1 and arms["투수3"].CG
    subs = [r.sub for r in landed.read_relay_second(spark, f"{root}/mlb/relay").filter("no = 1").orderBy("sub").collect()]
    assert subs == [1, 3, 4]
    record["homeBatter"][0]["hit"] = "two"
    write(f"{root}/mlb/record/game_date={DAY}/M1.json", {"result": {"recordData": record}})
    for _ in range(2):
        jobs.score_days(spark, root, mart, "mlb", [DAY])
    for table in ("batters", "pitchers"):  # the day has no row left, so none stays
        assert published.read(spark, mart, table).count() == 0
    assert [(r.game_id, r.league, str(r.game_date)) for r in published.read(spark, mart, "quarantine").collect()] == [("M1", "mlb", DAY)]
    assert [str(r.game_date) for r in published.done(spark, mart, "mlb").collect()] == [DAY]
    record["homeBatter"][0]["hit"] = 3
    write(f"{root}/mlb/record/game_date={DAY}/M1.json", {"result": {"recordData": record}})
    jobs.score_days(spark, root, mart, "mlb", [DAY])
    assert {r["name"] for r in published.read(spark, mart, "batters").collect()} == {"가", "나"}
    assert not published.read(spark, mart, "quarantine").count()


def test_batches_resume(spark, tmp_path, monkeypatch):
    """A reprocess that ends early keeps the marks of the parts that are written."""
    scored = []

    def score(spark, root, mart, league, days, *rest):
        if scored:
            raise RuntimeError("lost")
        scored.extend(days)

    monkeypatch.setattr(jobs, "score_days", score)
    monkeypatch.setattr(jobs, "BATCH", 2)
    days = ["2026-05-01", "2026-05-02", "2026-05-03"]
    with pytest.raises(RuntimeError):
        jobs.reprocess(spark, "in", "out", days, None, None, str(tmp_path / "run"))
    scored.clear()
    assert jobs.reprocess(spark, "in", "out", days, None, None, str(tmp_path / "run")) == ["2026-05-03"] == scored


def test_reference_tables(spark, tmp_path):
    path = tmp_path / "cost.csv"
    path.write_text("﻿동명,포지션,이름,코스트\n,1B,오,5\nLG7,SP,최,3\n", encoding="utf-8")
    assert [tuple(r) for r in tables.read_cost_csv(spark, str(path)).collect()] == [(None, "1B", "오", "5"), ("LG7", "SP", "최", "3")]
    write(str(tmp_path / "cal.json"), {DAY: {"round": "kbo_r", "game_ids": ["a", "b"]}, "2026-05-06": {"round": None, "game_ids": []}})
    days = {str(r.game_date): r for r in tables.read_calendar_json(spark, str(tmp_path / "cal.json")).collect()}
    assert days[DAY].game_ids == ["a", "b"] and days["2026-05-06"]["round"] is None
    write(str(tmp_path / "pos.json"), {"players": {"7": {"name": "김", "team": "LG", "effective_position": "포수", "innings_by_position": {"포수": 9.0}}}})
    assert tables.read_positions_json(spark, str(tmp_path / "pos.json")).first().player_code == "7"
    table = '<table class="tNData"><tr><th>번호</th><th> {} </th></tr><a href="/x?playerId=1">{}</a></table>'
    html = "머리" + table.format("투수", "밖") + "선수등록명단" + table.format("감독", "감") + table.format("투수", "김") + table.format("내야수", "김") + "등/말소 현황" + table.format("포수", "끝")
    page = spark.createDataFrame([("LG", DAY, html)], "team_code STRING, game_date STRING, html STRING")
    assert [(r["name"], r.category) for r in tables.roster_from_pages(page).collect()] == [("김", "내야수")]
    lineup = {"fullLineUp": [{"playerName": "선", "positionName": "선발투수"}, {"playerName": "타", "positionName": "유격수", "batorder": 3}, {"playerName": "벤치"}]}
    write(str(tmp_path / "pre" / "G9.json"), {"result": {"previewData": {"homeTeamLineUp": lineup}}})
    got = {r["name"]: (r.is_starting_pitcher, r.bat_order) for r in landed.read_lineups(spark, str(tmp_path / "pre")).collect()}
    assert got == {"선": (True, None), "타": (False, 3)}
    write(str(tmp_path / "days" / "data_20260501.json"), {"batters": [{"name": "김", "lp": 5, "pay": 3, "stat": {"H": 1}}], "pitchers": []})
    row = landed.read_day_files(spark, str(tmp_path / "days"), cost_field="pay").first()
    assert (str(row.game_date), row.lp, row.roster_cost, row.kind, row.stat["H"]) == ("2026-05-01", 5, 3, "batter", "1")


def test_refresh_marker(spark, tmp_path):
    from dugout.operators import schedule

    path = str(tmp_path / "marker")
    now = F.to_timestamp(F.lit("2026-05-05 10:00:00"))
    assert schedule.refresh_due(sinks.read_refresh_marker(spark, path), now).first().due
    sinks.mark_refreshed(spark, path, "2026-05-05 09:30:00")
    assert not schedule.refresh_due(sinks.read_refresh_marker(spark, path), now).first().due
    later = F.to_timestamp(F.lit("2026-05-05 10:30:00"))
    assert schedule.refresh_due(sinks.read_refresh_marker(spark, path), later).first().due


def test_live_tick(spark, landing, tmp_path):
    mart = str(tmp_path / "mart")
    costs = cost.read_costs(spark.createDataFrame([], "hint STRING, position STRING, name STRING, cost STRING"))
    assert not jobs.run_day(spark, landing, mart, DAY, f"{DAY} 07:00:00", costs)  # 16:00 in Korea
    assert jobs.run_day(spark, landing, mart, DAY, f"{DAY} 10:00:00", costs)
    rows = {r["name"]: r for r in published.read(spark, mart, "batters").collect()}
    assert rows["유격"].position == "유격수" and rows["유격"].roster_cost is None
    again = jobs.refresh_if_due(spark, jobs.read_landing(spark, landing, "kbo"), mart, DAY, f"{DAY} 10:30:00")
    assert {r.player_code: r.effective_position for r in again.collect()}["2"] == "1루수"
