"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dugout.plans import queries as q  # noqa: E402
from dugout.session import build_session  # noqa: E402

HEADLINE = (
    "pa_class_counts", "batter_lp", "pitcher_lp", "special_records", "auto_position", "cost_lookup",
    "relay_kinds", "pitcher_in_charge", "line_credits", "inherited_runners", "earned_run_origin",
    "scored_batters", "play_ledger", "second_league_batters", "leaderboard", "kth_threshold",
    "player_history", "daily_tiles", "optimal_roster_value", "pregame_batters", "calendar_rounds",
    "roster_pages", "split_lines", "live_refresh",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    q.ALL["final_score"](spark, folder).write.format("noop").mode("overwrite").save()  # warm the JVM
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        q.ALL[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": os.path.basename(folder.rstrip("/")).replace("sf", ""),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
