"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores.  The
stored tables every query reads are built first and timed as their own entries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

STORED = ("players", "teams", "percentiles", "player_matches", "shots", "team_shots")
HEADLINE = (
    "population_percentiles",
    "stored_percentiles",
    "exposure_rates",
    "shrunk_rates",
    "team_season_rollup",
    "entity_profile",
    "extreme_metrics",
    "season_change",
    "nearest_profiles",
    "all_neighbours",
    "sharpest_contrast",
    "scouting_search",
    "team_market_value",
    "event_summary",
    "conceded_summary",
    "cumulative_trajectory",
    "entity_form",
    "flatten_history",
    "normalise_name",
    "keyed_upsert",
    "standardise",
    "match_in_block",
    "identity_match",
    "match_clubs",
    "confirm_by_history",
    "identity_cascade",
    "assign_roles",
    "team_styles",
    "role_percentiles",
    "snapshot_upsert",
    "target_loads",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from levelfield.plans import load
    from levelfield.plans.workspace import workspace

    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("levelfield-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load().QUERIES
    ws = workspace(spark, directory)
    seconds: dict[str, float] = {}
    for name in STORED:
        start = time.perf_counter()
        getattr(ws, name)
        seconds[f"store_{name}"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, directory).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": directory.rsplit("sf", 1)[-1],
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
