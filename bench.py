"""Wall time per query, warm, on local[$BENCH_CPUS]; prints one JSON line.

The star schema and the derived tables that several queries read are staged first and reported
on their own (``stage_*``); every query then reads staged tables the way a daily job would. Each
query is run to the end (all columns of all rows) without fetching its result: once to warm up, then
$BENCH_RUNS times, whatever it takes; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tallybird.plans.churn_training import staged_features
from tallybird.plans.registry import QUERIES
from tallybird.plans.warehouse import (
    customer_rfm,
    review_sentiment,
    rfm_base,
    staged_raw,
    star_schema,
)
from tallybird.session import local_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", str(min(8, os.cpu_count() or 1))))
RUNS = int(os.environ.get("BENCH_RUNS", "1"))


def timed(work) -> float:
    start = time.perf_counter()
    work()
    return time.perf_counter() - start


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS, memory=os.environ.get("BENCH_MEMORY", "16g"))
    seconds = {
        "stage_raw_tables": timed(lambda: staged_raw(spark, FOLDER)),
        "stage_star_schema": timed(lambda: star_schema(spark, FOLDER)),
        "stage_rfm_base": timed(lambda: rfm_base(spark, FOLDER)),
        "stage_customer_rfm": timed(lambda: customer_rfm(spark, FOLDER)),
        "stage_review_sentiment": timed(lambda: review_sentiment(spark, FOLDER)),
        "stage_churn_features": timed(lambda: staged_features(spark, FOLDER)),
    }
    for name, query in QUERIES.items():
        run = lambda: timed(lambda: drain(query(spark, FOLDER)))
        run()
        seconds[name] = statistics.median(run() for _ in range(RUNS))
    seconds = {name: round(value, 3) for name, value in seconds.items()}
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
                "cpus": CPUS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
