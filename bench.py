"""Time the headline queries on the driver's tables and print one JSON line."""

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from zonespark.catalog.registry import BUILDERS, Tables  # noqa: E402

VIEWS = ["img", "ims", "zon", "nz", "det", "reg", "tight", "lay", "lays", "lay2", "lays2", "tag", "fil"]
#: Runs per query, of which the median counts.
RUNS = int(os.environ.get("BENCH_RUNS", "1"))

HEADLINES = [
    "F2_search_images", "A2_filter_counts", "A3_group_library", "A6_layout_union", "A8_export_rows", "A11_combo_conflicts",
    "J1_uncovered_frame", "A16_coverage_report", "J3_plan_merge", "J9_preview_counts", "D2_detections", "D3_merge_boxes",
    "W1_review_queue", "E2_export_v2", "S1_scan_images", "S3_scan_dicom_tags", "S9_backup_round_trip", "ST1_stream_import",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("zonespark-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    # The operators' input tables are stored before anything is timed, as a user's tables are.
    tables = Tables(spark, sf_dir)
    tables.write(*VIEWS)

    def timed(build) -> float:
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    # One untimed query starts the Python workers and warms the compiler.
    timed(lambda: BUILDERS["A1_box_counts"](tables))
    seconds = {
        name: round(median(timed(lambda name=name: BUILDERS[name](tables)) for _ in range(RUNS)), 3) for name in HEADLINES
    }
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total time", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
