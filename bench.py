"""Times headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is built and run to the end (every column of every row is computed
and dropped). Two queries run untimed before, to start the JVM's compiler and the
Python workers.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from testbed.compare import local_session  # noqa: E402
from testbed.queries import QUERIES  # noqa: E402

HEADLINE = """
criticality_windowed criticality_with_undated backlog_latest_high feature_trend
reviews_filtered_page reviews_filtered_total reviews_with_aspects
feature_priorities kpi_summary clean_pages clean_documents dedup_near dedup_accounting
review_records nest_annotations split_grouped split_documents training_master
training_sentiment multi_hot category_pos_weights sentiment_class_weights keyword_tags
routed_aspects aspects_resolved gold_category_labels gold_sentiment_pairs
category_metrics threshold_sweep sentiment_metrics
""".split()

WARM_UP = ("criticality_windowed", "routed_aspects")


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=cpus)
    for name in WARM_UP:
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
