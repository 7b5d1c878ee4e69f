"""Times the headline queries on one node and prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tagloom.catalog import QUERIES  # noqa: E402
from tagloom.session import build_session  # noqa: E402

# whole flows and their costly steps; steps inside a listed flow are not listed again
HEADLINE = (
    "prepare_samples", "a1_prep_summary", "a4_label_by_split", "p14_preprocess_code", "c4_build_elements",
    "w1_vocab_topk", "w7_vocab_index", "f2_tfidf_transform", "m9_run_base_experiment", "e9_compute_metrics",
    "e11_auroc_by_label", "r5_build_rule_table", "r12_run_enhanced", "r13_run_aligned_enhanced",
    "c9_aggregate_nodes_by_file", "x1_stream_prepare",
)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", shuffle_partitions=max(int(cpus), 1))
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    seconds = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
