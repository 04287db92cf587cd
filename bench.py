"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query is run in full into Spark's ``noop`` sink: nothing is collected, and no column
or row is pruned away by a count.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from segue.catalog.load import QUERIES  # noqa: E402
from segue.session import drop_materialised, local_session  # noqa: E402

HEADLINE = (
    "match_report", "path_rules_rewrite", "path_rules_table", "simplified_grids", "expanded_beats",
    "tempo_sections", "merged_cues", "merged_playlists", "dimension_rows", "library_summary",
    "mixxx_slots", "signal_columns", "signal_preview", "device_tracks", "crate_paths",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = local_session("segue-bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # session start is not a query
    took: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(took.values()), 3),
                "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").split("sf")[-1],
                "cpus": cpus,
            }
        )
    )
    drop_materialised(spark)
    spark.stop()


if __name__ == "__main__":
    main()
