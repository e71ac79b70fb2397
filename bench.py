"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the folder of tables, ``BENCH_CPUS`` the local cores.
Every query is run from the tables to its last row; nothing is kept in between.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conceptloom.plans.catalog import ENTRIES  # noqa: E402
from conceptloom.session import local_session  # noqa: E402

HEADLINE = (
    "row_masks", "attribute_support", "closure_pairs", "closure_sets",
    "fca_concepts_nation", "fca_covers_nation",
    "fca_concepts_order_lines", "fca_covers_order_lines",
    "fca_concepts_docs", "fca_covers_docs",
    "fca_concepts_brand", "fca_covers_brand",
    "fca_concepts_nation_month", "fca_covers_nation_month",
    "fca_concepts_supplier_brand", "fca_covers_supplier_brand",
    "concepts_join_method", "labelled_concepts", "full_extents",
    "dot_lines", "expand_reduced_to_full", "compare_same", "run_pivot",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    ENTRIES["fca_concepts_cust_prio"].run(spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        ENTRIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
