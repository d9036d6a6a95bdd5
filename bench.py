"""Headline queries, timed one by one after a warm-up. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default all) choose data and cores.
"""

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, os.environ.get("PYTHONPATH")) if p)

from notegrid.probes import QUERIES  # noqa: E402
from notegrid.session import build_session  # noqa: E402

HEADLINE = [
    "select_all_of", "count_rows", "limit_rows", "sort_rows", "recent_rows", "orders_under_region", "resolve_links",
    "relation_quantifier", "is_descendant_of", "tree_rows", "lineage_component", "field_facts", "option_drift", "audit",
    "audit_summary", "audit_bodies", "validate_rows", "search_lines", "search_rank", "fuzzy_rank", "mentions_exact",
    "mentions_fuzzy", "frequent_terms", "word_forms", "transitions", "guard_check", "spawn_successors", "relative_dates",
    "derive_fields", "bulk_chain", "bulk_apply", "repair", "migrate_options", "backlinks", "write_notes"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    threads = os.cpu_count() if cpus == "*" else int(cpus)
    spark = build_session("bench", **{
        "spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": str(threads),
        "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:]
    names = [n for n in HEADLINE if not only or n in only]
    QUERIES["count_rows"](spark, folder).collect()  # start-up costs belong to no query
    took = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total time of headline queries", "value": round(sum(took.values()), 3),
                      "unit": "sec", "queries": took, "sf": scale}))
    spark.stop()


main()
