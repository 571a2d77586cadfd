"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import functions as F

from tempora.plans import queries as _registered  # noqa: F401
from tempora.plans.registry import QUERIES
from tempora.session import get_session
from tempora.sources.delimited import read_delimited

NAMES = [
    "profile_day_all", "envelope_bucketed", "envelope_multi_var", "missing_buckets", "pair_correlation", "linear_fit", "histogram_auto_fd",
    "heatmap_week_day", "heatmap_integral_day_hour", "sampling_gaps", "moving_average", "integral_trapezoidal", "derivative_centered", "derived_formula", "spectrum_hann",
]


def text_file(spark, folder: str, rows: int = 1_500_000, variables: int = 9) -> str:
    """A delimited file of a time and some variables, about 100 MB, made once before the clock starts."""
    path = f"{folder}/wide.csv"
    time_ = F.date_format(F.timestamp_millis(F.col("id") * 1000 + 1_704_067_200_000), "yyyy-MM-dd HH:mm:ss")
    made = [F.round(F.sin(F.col("id") / (50 + 13 * k)) * (k + 1), 4).alias(f"v{k}") for k in range(variables)]
    spark.range(rows).select(time_.alias("time"), *made).write.option("header", True).csv(path)
    return path


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = get_session(
        f"local[{os.environ.get('BENCH_CPUS', '8')}]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false", spark__checkpoint__dir=f"file://{folder}",
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    path = text_file(spark, f"file://{folder}")
    work = {"csv_1500k_x_9": lambda spark, _: read_delimited(spark, path)} | {name: QUERIES[name] for name in NAMES}
    for name, query in work.items():
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(min(runs[1:]), 4)
    print(json.dumps({"metric": "total_best_seconds", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
