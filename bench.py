"""Times the headline queries and prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], *filter(None, [os.environ.get("PYTHONPATH")])])  # for Python workers

from pyspark.sql import SparkSession  # noqa: E402

from pagewright.operators import incremental  # noqa: E402
from pagewright.operators import index as I  # noqa: E402
from pagewright.plans import context, search  # noqa: E402
from pagewright.queries import common, load  # noqa: E402
from pagewright.sources import tables  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ("search_topk", "search_nograph", "search_nofold", "lex_pages", "coverage_signals", "ppr_scores", "ir_metrics", "rrf_fusion", "vector_topk", "scan_rank", "warning_kinds", "layout_xy", "map_rows", "dup_damping", "events_sessions", "percentile_summary", "auc")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name, f):
        began = time.time()
        out = f()
        took[name] = round(time.time() - began, 3)
        return out

    queries = load()[0]
    spark.read.parquet(f"{SF}/documents.parquet").count()
    common.index(spark, "/root/testdata/sf0.001" if os.path.isdir("/root/testdata/sf0.001") else SF)  # compiles code
    kb = timed("load_pages", lambda: common.base(spark, SF))
    idx = timed("build_index", lambda: common.index(spark, SF))
    q = tables.questions(spark, SF)
    n = q.count()
    for name in HEADLINE:
        timed(name, lambda name=name: queries[name](spark, SF).write.format("noop").mode("overwrite").save())
    timed("search_again", lambda: search.search(idx, q).write.format("noop").mode("overwrite").save())
    timed("contexts", lambda: context.contexts(idx, q).write.format("noop").mode("overwrite").save())
    changed = kb.pages.filter("page_id LIKE '%77'").select("page_id")
    timed("incremental_1_percent", lambda: incremental.apply(idx, kb, changed))
    timed("rebuild", lambda: I.build(kb))
    print(json.dumps({"metric": "sum of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF, "search_queries": n, "ms_per_search_query": round(1000 * took["search_again"] / max(1, n), 1), "cpus": CPUS, "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
