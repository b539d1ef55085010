"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import tempfile
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = HERE + os.pathsep + os.environ.get("PYTHONPATH", "")
SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: The feature chain, serving statistics, evaluation and search queries whose like the baseline reports.
HEADLINE = "w4_expanding l2_career l3_jockey_trainer l8_race_context l16_market l22_head_to_head l29_similar_race l31_cells l40_style_features j6_asof j16_fallback a13_bucket_eval a18_ndcg_ideal a31_bloodline a32_people a50_bucket_tiers m4_blend m6_search_weights k4_knn_features t5_merge".split()


def main() -> None:
    from pyspark.sql import SparkSession

    from furlong import catalogue

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-")).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = catalogue.queries(), {}
    queries["w4_expanding"](spark, SF).write.format("noop").mode("overwrite").save()  # starts the executors' code
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, SF).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF.rstrip("/"))}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
