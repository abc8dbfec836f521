import json
import random

import pytest
from pyspark.sql import functions as F

from dugout.model import RELAY_EVENTS
from dugout.operators import relay
from dugout.streaming import linestore, live
from test_relay import random_games

NAMES = ["game_id", "no", "sub", "inn", "half", "out", "base", "home_score", "away_score", "text"]


def test_late_and_corrected_lines_end_like_the_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(linestore, "COMPACT_AFTER", 2)
    rows = random_games(4, seed=9)
    days = {g: f"2026-05-0{1 + int(g[1:]) % 2}" for g in {r[0] for r in rows}}
    lines = [dict(zip(NAMES, r), game_date=days[r[0]], ingested_at="2026-05-05T10:00:00") for r in rows]
    wrong = [dict(x, text="1구 볼", ingested_at="2026-05-05T09:00:00") for x in lines[::7]]
    sent = lines + wrong
    random.Random(3).shuffle(sent)
    land, mart, store = tmp_path / "land", str(tmp_path / "mart"), str(tmp_path / "store")
    land.mkdir()

    def recompute(session, touched, latest):
        opened = {f.split("game_date=")[1][:10] for f in latest.inputFiles()}
        assert opened == set(touched)  # no day is opened but those that were touched
        facts = relay.relay_facts(latest, None)
        day = latest.select("game_id", "game_date").distinct()
        totals = facts.credits.groupBy("game_id", "name", "role").agg(F.sum("points").alias("points"))
        totals.join(day, "game_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "game_date"
        ).parquet(mart)

    for part in range(3):
        mine = [x for x in sent[part::3] if part != 2 or x["game_date"] == "2026-05-01"] + ([x for x in sent[2::3] if x["game_date"] != "2026-05-01"] if part == 1 else [])
        body = "\n".join(json.dumps(x, ensure_ascii=False) for x in mine)
        (land / f"part{part}.json").write_text(body, encoding="utf-8")
        stream = live.read_line_stream(spark, str(land))
        linestore.follow(stream, store, recompute, str(tmp_path / "offsets"), available_now=True).awaitTermination()
    got = {(r.game_id, r["name"], r.role): r.points for r in spark.read.parquet(mart).collect()}
    batch = relay.relay_facts(spark.createDataFrame(rows, RELAY_EVENTS), None).credits
    want = {
        (r.game_id, r["name"], r.role): r.points
        for r in batch.groupBy("game_id", "name", "role").agg(F.sum("points").alias("points")).collect()
    }
    assert got == want
    assert spark.read.parquet(f"{store}/compacted").count() >= 2


def test_versions_of_lines(spark, tmp_path, monkeypatch):
    """The latest version counts however it arrives; a batch played again and a compaction that is lost change nothing."""
    store = str(tmp_path)
    r = random.Random(6)
    versions = [("G%d" % r.randrange(5), r.randrange(3), r.randrange(4), f"text {r.randrange(40)}", f"2026-05-05 {r.randrange(10, 20)}:00:00", f"2026-05-0{1 + r.randrange(2)}") for _ in range(300)]
    schema = "game_id STRING, no INT, sub INT, text STRING, ingested_at STRING, game_date STRING"

    def batch(rows):
        df = spark.createDataFrame(rows, schema).withColumns({"ingested_at": F.to_timestamp("ingested_at"), "game_date": F.to_date("game_date")})
        return df.select("game_id", "no", "sub", F.lit(1).alias("inn"), F.lit("0").alias("half"), F.lit(0).alias("out"), F.array(F.lit("0")).alias("base"),
                         F.lit(0).alias("home_score"), F.lit(0).alias("away_score"), "text", "ingested_at", "game_date")

    def want(rows, day):
        best = {}
        for x in rows:
            if x[5] == day:
                best[x[:3]] = max(best.get(x[:3], ("", "")), (x[4], x[3]))
        return sorted((*k, v[1]) for k, v in best.items())

    def got(day):
        return sorted((x.game_id, x.no, x.sub, x.text) for x in linestore.lines(spark, store, [day]).collect())

    days = ["2026-05-01", "2026-05-02"]
    for i in range(4):
        linestore.append(batch(versions[i * 60 : i * 60 + 60]), store, i)
    linestore.append(batch(versions[60:120]), store, 1)  # played again
    linestore.append(batch([(*versions[0][:5], None)]), store, 9)  # without a day
    assert [got(d) for d in days] == [want(versions[:240], d) for d in days]
    real = linestore._write
    with monkeypatch.context() as m:
        m.setattr(linestore, "_write", lambda *x: (real(*x), 1 / 0))
        with pytest.raises(ZeroDivisionError):
            linestore.compact(spark, store, days)
    assert [got(d) for d in days] == [want(versions[:240], d) for d in days]
    linestore.compact(spark, store, days[:1])
    batches = [r.batch for r in linestore._stored(spark, store, days[:1]).select("batch").distinct().collect()]
    assert [x[0] for x in batches] == ["m"]
    linestore.append(batch(versions[240:]), store, 10)
    assert [got(d) for d in days] == [want(versions, d) for d in days]
    linestore.compact(spark, store, days)
    assert [got(d) for d in days] == [want(versions, d) for d in days]
    assert linestore.lines(spark, store, ["2027-01-01"]).count() == 0
