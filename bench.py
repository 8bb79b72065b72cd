"""Time the headline queries; print one JSON line.

BENCH_SF_DIR   input folder (default /root/testdata/sf0.1)
BENCH_CPUS     local threads (default 8)
BENCH_QUERIES  comma-separated subset, for work on single queries
"""

from __future__ import annotations

import glob
import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cardloom.plans.queries import QUERIES  # noqa: E402
from cardloom.session import local_session  # noqa: E402

HEADLINE = (
    "normalize_documents",
    "document_tokens",
    "type_features",
    "card_labels",
    "document_labels",
    "labels_long",
    "enriched_join",
    "row_alignment_check",
    "cluster_stats",
    "cluster_top_items",
    "cluster_representatives",
    "tfidf_vocabulary",
    "tfidf_weights",
    "cluster_top_terms",
    "similar_to_doc",
    "similar_batch",
    "similar_all_pairs",
    "kmeans_clusters",
    "projection_2d",
)


# Files a table is laid out in before the timing: a table of many row groups, as large
# tables are, keeps all cores busy from the first stage.
FILES = 16


def laid_out(spark, sf_dir: str) -> str:
    """A copy of the tables in several files each, made once and not timed."""
    out = tempfile.mkdtemp(prefix="bench-")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        spark.read.parquet(path).repartition(FILES).write.parquet(f"{out}/{os.path.basename(path)}")
    return out


def main() -> None:
    given = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = laid_out(spark, given)
    # Start the Python workers and compile the common paths before timing.
    QUERIES["value_counts"](spark, sf_dir).collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    spark.stop()
    shutil.rmtree(sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(given.rstrip("/")).removeprefix("sf"),
                "layout": f"each table copied to {FILES} Parquet files before timing",
            }
        )
    )


if __name__ == "__main__":
    main()
