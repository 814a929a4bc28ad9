"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tidemark.plans import catalog, stand_ins
from tidemark.session import build_session, own_folder

HEADLINE = (
    "ft_cell_median_premium", "ft_entry_competition", "ft_size_bucket", "cln_outlier_cells",
    "cln_keep_first", "cln_waterfall", "nrm_duration_event", "agg_premium_stats", "win_status_runs",
    "aud_leave_one_out", "aud_ks", "reg_least_squares", "reg_hedonic_premium", "reg_cox",
    "reg_concordance", "cube_revenue", "cube_arrival_discount", "plan_violations", "scn_summary",
    "mac_dispersion",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        cpus, "tidemark-bench", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__checkpoint__dir=own_folder(),
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = catalog.queries()
    spark.read.parquet(f"{folder}/lineitem.parquet").agg({"l_tax": "sum"}).collect()
    times: dict[str, float] = {}

    def timed(name: str, job) -> None:
        start = time.perf_counter()
        job()
        times[name] = round(time.perf_counter() - start, 3)

    # Reading and parsing the export is measured on its own, then each query.
    timed("land_export", lambda: stand_ins.raw_export(spark, folder))
    timed("normalize_listings", lambda: stand_ins.normalized(spark, folder))
    for name in HEADLINE:
        timed(name, lambda: found[name](spark, folder).write.format("noop").mode("overwrite").save())
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
