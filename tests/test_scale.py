"""What held on small tables only: large numbers, estimates, rows a task and disk."""

import glob
import gzip
import json
import os

from pyspark.sql import functions as F

from dugout.model import BATTER_COUNTERS
from dugout.operators import box, differ, merge, positions as pos, relay
from dugout.plans import bindings, day_queries
from dugout.session import OPEN_FILES, SHORT_SHUFFLES, SORTED_GROUPS, settings
from dugout.sources import landed, staging


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_error_lines_of_late_records(spark):
    batters = spark.createDataFrame([("g", "V1", False, 0, False)], "game_id STRING, name STRING, ambiguous BOOLEAN, GRANDSLAM INT, CYCLE BOOLEAN")
    log = spark.createDataFrame(
        [], "game_id STRING, name STRING, role STRING, no INT, sub INT, ord INT, inn INT, text STRING, tag STRING, n INT, points INT, pos STRING")
    mentions = spark.createDataFrame([("g", "E", 5_999_999, 1, "V1", 3)], "game_id STRING, counter STRING, idx INT, item INT, name STRING, inn INT")
    rows = merge.batter_box_lines(batters, log, mentions).collect()
    assert [(r.ord, r.inn, r.tag) for r in rows] == [(5_999_999_001, 3, "E")]


def test_game_info_is_not_broadcast(spark, tmp_path):
    docs = [('{"result": {"recordData": {"gameInfo": {"gdate": "20260501", "stadium": "s", "hName": "h", "aName": "a"}, '
             '"etcRecords": [{"how": "x", "result": " y "}, {"how": "z", "result": "w"}]}}}', f"g{i}") for i in range(20)]
    frame = spark.createDataFrame(docs, "doc STRING, key STRING").select("key", F.from_json("doc", landed.RECORD).alias("d")).select("key", "d.result")
    frame.write.parquet(str(tmp_path / "docs"))
    records = landed.records_of(spark.read.parquet(str(tmp_path / "docs")))
    joined = landed.etc_records(records).join(landed.game_info(records), "game_id")
    assert joined.count() == 40
    assert "Broadcast" not in plan(joined)


def test_parts_of_the_relay_are_not_merged(spark):
    events = spark.range(4000).select(F.col("id").cast("string").alias("game_id"), F.lit(1).alias("no"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert relay.by_chunk(events).rdd.getNumPartitions() == parts


def test_difference_moves_rows_by_key_alone(spark):
    frames = [spark.createDataFrame([("kbo", day, "g", lp) for day in range(3)], "league STRING, day INT, game STRING, lp INT") for lp in (1, 2)]
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = differ.mart_difference(*frames, ("league", "day"), ("game",), ("lp",))
        assert found.count() == 3
        assert "LeftSemi" not in plan(found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_digests_tell_nulls_apart(spark):
    schema = "league STRING, game STRING, a STRING, b STRING, c ARRAY<INT>"
    values = [("x", None, [1, None]), (None, "x", [1, None]), ("x", "", [1, None]), ("x", None, [None, 1]), ("x", None, None)]
    found = {tuple(differ.bucket_digests(spark.createDataFrame([("kbo", "g", *v)], schema), ["league"], ["game"], ["a", "b", "c"]).first()) for v in values}
    assert len(found) == len(values)


def test_days_that_no_window_holds(spark):
    games = spark.createDataFrame([(f"2026-05-{d:02}", f"g{d}") for d in range(1, 32)], "day STRING, game_id STRING").withColumn("game_date", F.to_date("day"))
    ends = games.select(F.last_day("game_date").alias("end_date"))
    assert sorted(r.game_id for r in pos.reached(games, ends).collect()) == [f"g{d}" for d in range(18, 32)]


def test_partials_stay_where_they_are_for_the_ends(spark):
    partials = spark.createDataFrame(
        [("2026-05-20", "p1", "포수", 3.0, 1, 1, 1, 1, "n", "t")],
        "day STRING, player_code STRING, position STRING, innings DOUBLE, seen INT, rows INT, first_place INT, last_place INT, name STRING, team STRING",
    ).withColumn("game_date", F.to_date("day"))
    ends = spark.sql("select date '2026-05-31' as end_date")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = pos.rolling_table(partials, ends)
        assert [(r.player_code, r.auto_position) for r in table.collect()] == [("p1", "포수")]
        assert "SortMergeJoin" not in plan(table)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_team_outs_move_no_row_again(spark):
    """Pitchers are moved by the game alone; a side that is null or has no outs finds none, and repeated outs repeat rows."""
    text = "game_id string, side string, pos_idx int, name string, inn string, hit int, r int, er int, hr int, bb int, bbhp int, kk int, wls string"
    rows = [("1", side, 0, "a", "9", *[0] * 7, "") for side in ("home", "away", None)] + [(None, "home", 0, "b", "9", *[0] * 7, "")]
    pitchers = spark.createDataFrame(rows, text)
    outs = spark.createDataFrame([("1", "home", 27), ("1", "home", 27), ("1", None, 27), (None, "home", 27)], "game_id string, side string, team_outs int")
    status = spark.createDataFrame([("1", "RESULT")], "game_id string, status_code string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counted = box.pitcher_counters(pitchers, outs, status, None)
        moved = plan(counted).count("Exchange hashpartitioning")
        found = sorted((tuple(r) for r in counted.select("game_id", "side", "CG").collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert moved == 3
    assert found == sorted([("1", "home", True)] * 2 + [("1", "away", False), ("1", None, False), (None, "home", False)], key=str)


def test_batter_rows_are_read_without_comparators(spark):
    """Slots go by number, counters that are blank or junk are told apart, and no row is sorted by an interpreted comparison."""
    man = {"name": "a", "inn10": "c", "inn2": "b", "inn1": "a", "inn0": "x", "innX": "x", "ab": " 3　", "hit": "", "run": "2", "rbi": "x", "hr": " 1", "bb": None}
    sides = {"home": [man, {"name": "b"}], "away": None}
    records = spark.createDataFrame([("1", {"battersBoxscore": sides})], "game_id string, record struct<battersBoxscore: struct<home: array<map<string,string>>, away: array<map<string,string>>>>")
    rows = landed.batters(records)
    assert "array_sort" not in plan(rows) and "lambda p" not in plan(rows)
    first, second = sorted(rows.collect(), key=lambda r: r.pos_idx)
    assert (first.side, first.pos_idx, first.pa_codes) == ("home", 0, ["a", "b", "c"])
    assert (first.ab, first.hit, first.run, first.rbi, first.hr, first.bb, first.kk) == (3, 0, 2, None, 1, 0, 0)
    assert (second.side, second.pos_idx, second.pa_codes) == ("home", 1, [])


def test_lines_that_do_not_apply_are_null(spark):
    state = spark.createDataFrame([("r", "p", None, None)], "name string, pitcher string, from_base int, at_1 string")
    state = state.withColumns({c: F.lit(None).cast("string") for c in relay.DEFENSE.values()})
    lines = state.select(relay._steal_lines().alias("lines")).first().lines
    assert [line and line.tag for line in lines] == ["SB", None, "SB_ALLOWED", None]


def test_box_rows_are_joined_once_with_what_the_relay_knows(spark):
    credits = spark.createDataFrame(
        [("1", "a", "bat", 1, 1, 0, 1, "t", "ASSIST", 1, 1, "유격수"), ("1", "b", "bat", 1, 1, 0, 1, "t", "PLAY:BUNT_OUT", 1, 0, None)],
        "game_id string, name string, role string, no int, sub int, ord int, inn int, text string, tag string, n int, points int, pos string")
    advances = spark.createDataFrame([("1", "a", 2), ("1", "c", 1)], "game_id string, name string, advance int")
    facts = relay.RelayFacts(credits, None, None, None, advances)
    batters = spark.createDataFrame([("1", n, "유격수") for n in ("a", "b", "c", "d", None)], "game_id string, name string, position string")
    batters = batters.select("*", *[F.lit(1).alias(c) for c in BATTER_COUNTERS])
    found = merge.merge_batters(batters, facts)
    assert plan(found).count("LeftOuter") == 3  # twice whether a name is told apart, once this
    assert {r.name: (r.ASSIST, r.GO, r.ADVANCE_OUT) for r in found.collect()} == {"a": (1, 1, 2), "b": (0, 0, 0), "c": (0, 1, 1), "d": (0, 1, 0), None: (0, 1, 0)}


def test_plate_code_is_stored_before_its_class(spark, tmp_path):
    spark.createDataFrame([(1, 1, None, '{"k": 3}')], "event_id bigint, user_id bigint, ts timestamp, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert plan(bindings.relay_box_batters(spark, str(tmp_path))).count("= 33)") <= 2


def test_landed_batters_leave_little_on_disk(spark, tmp_path, monkeypatch):
    """Lines move once, as the columns they are made of; documents are landed compressed, and parsed ones do not move."""
    schema = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_linestatus string, l_returnflag string, l_comment string"
    lines = [(1, 20, 3, 1, 5.0, "F", "R", "x"), (1, 20, 3, 1, 5.0, "F", "R", "x"), (1, 10, 4, 2, 41.0, "F", "A", "x"), (1, 7, 5, 3, 7.0, "O", "N", "x"),
             (2, 18, 6, 1, None, None, None, "x"), (2, None, 6, 2, 8.0, "O", "A", "x"), (15, 11, 7, 1, 9.0, "F", "N", "x")]
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(day_queries, "shared_folder", lambda spark: str(tmp_path))
    names, hints, kind = SHORT_SHUFFLES | OPEN_FILES | SORTED_GROUPS, [], type(spark.range(0))
    before, hint = {name: spark.conf.get(name, None) for name in names}, kind.hint
    monkeypatch.setattr(kind, "hint", lambda self, name, *a: hints.append(name) or hint(self, name, *a))
    with settings(spark, SORTED_GROUPS):
        games = bindings.line_batters(spark, str(tmp_path), by_game=True).groupBy("order").agg(F.collect_list(F.struct("name", "pa_codes")).alias("l"))
        steps = plan(games)
    assert steps.count("Exchange") == steps.count("Sort [") == steps.count("SortAggregate(") == 1
    assert "HashAggregate" not in steps and "pa_codes" not in steps[steps.index("Exchange"):]
    found = day_queries.landed_batters(spark, str(tmp_path))
    rows = sorted((r.game_id, r.side, r.pos_idx, r.name, r.ab, r.substitute_in) for r in found.collect())
    assert rows == [
        ("1", "away", 0, "P5", 2, 0), ("1", "home", 0, "P4", 1, 0), ("1", "home", 1, "P3", 0, 1), ("1", "home", 2, "P3", 0, 1),
        ("15", "home", 0, "P7", 4, 0), ("2", "away", 0, "P6", 0, 0), ("2", "away", 1, "P6", 0, 0)]
    files = glob.glob(f"{tmp_path}/landing-*/kbo/record/game_date=*/part-*")
    assert files and all(f.endswith(".json.gz") for f in files)
    assert "rebalance" not in hints
    assert {name: spark.conf.get(name, None) for name in names} == before


def test_packed_files_may_be_compressed(spark, tmp_path):
    """Plain and compressed packed files of a day are staged; a compressed file that is no packed one is left where it is."""
    doc = lambda n: json.dumps({"key": f"g{n}", "doc": {"result": {"recordData": {"gameInfo": {"stadium": str(n)}}}}}).encode()
    day = f"{tmp_path}/land/kbo/record/game_date=2026-05-05"
    os.makedirs(day)
    with open(f"{day}/a.json", "wb") as plain, gzip.open(f"{day}/b.json.gz", "wb") as compressed:
        plain.write(doc(1))
        compressed.write(doc(2) + b"\n" + doc(3))
    assert staging.landed_files(spark, f"{tmp_path}/land/kbo/record", None).count() == 1
    assert staging.refresh(spark, f"{tmp_path}/land", f"{tmp_path}/stage", "kbo", packed=True) == {"record": ["2026-05-05"]}
    docs = staging.documents(spark, f"{tmp_path}/stage", "kbo", "record")
    assert sorted((r.key, r.result.recordData.gameInfo.stadium, str(r.game_date)) for r in docs.collect()) == [(f"g{n}", str(n), "2026-05-05") for n in (1, 2, 3)]
    assert staging.refresh(spark, f"{tmp_path}/land", f"{tmp_path}/stage", "kbo", packed=True) == {}
