"""Times the loads and reports on one folder of tables; prints one JSON line.

BENCH_SF_DIR names the folder, BENCH_CPUS the cores. Loads are timed over the written tables they
need, reports over the written star, as in a scheduled job. Each is run once unmeasured on the
session to get code compiled and then timed once; results are written to the noop sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from rosterlake.plans.warehouse import warehouse  # noqa: E402
from rosterlake.registry import REGISTRY  # noqa: E402
from rosterlake.session import clear_written, local_session  # noqa: E402

HEADLINE = [
    "j03_employees",
    "j04_job_history",
    "j09_dim_employee",
    "j11_dim_assignment",
    "j12_fact_reviews",
    "j16_changes_history",
    "c07_version_of_date",
    "c09_latest_assignment",
    "e05_previous_values",
    "e08_review_sequence",
    "i01_scale_to_target",
    "i11_version_set",
    "k01_key_figures",
    "k02_top_performers",
    "k03_yearly_trend",
    "k04_yearly_change",
    "k05_quarterly_trend",
    "k06_attrition_counts",
    "k07_department_summary",
    "k08_attrition_rate",
    "k10_income_by_level",
    "k11_top_earners",
    "k12_headcount_growth",
    "k13_project_load",
    "l06_overlaps",
    "l13_dropped_reviews",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)

    began = time.perf_counter()
    tables = warehouse(spark, sf_dir)
    for name in ("dim_assignment", "fact_performance_reviews", "changes", "raw_people", "dirty_versions"):
        tables[name].count()
    build = time.perf_counter() - began

    seconds: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
    line = {
        "metric": "headline_total",
        # What the loads and reports need first is part of the total.
        "value": round(build + sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
        "warehouse_build_cold": round(build, 3),
        "cpus": cpus,
    }
    clear_written(spark)
    print(json.dumps(line))


if __name__ == "__main__":
    main()
