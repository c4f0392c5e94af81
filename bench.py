"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgergraph.plans import QUERIES  # noqa: E402
from ledgergraph.session import local_session  # noqa: E402

HEADLINES = [
    "f2_industry_trend", "f2_industry_ranking", "f1_metric_trend", "e3_graph_metrics", "e6_company_profile",
    "e7_risk_profile", "c6_paths_from_regions", "c7_subgraph_edges", "h3_similar_customers", "h2_merged_vertices",
    "v10_entity_findings", "v11_relationship_findings", "e8_entity_reports", "k29_applied_log", "i8_by_day",
    "i9_correlations", "i14_quartiles", "f5_anomalies", "s3_current_status", "s2_status_stream", "a9_text_statistics",
    "b1_mentions", "d6_relations", "j1_classified_statements", "x6_dangling", "c8_neighbours_of_nations",
    "i2_endpoint_validity", "d7_relation_details", "d8_context_flags", "d14_document_graph", "c11_mentions_to_fields",
    "k30_suggested_corrections",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "*")
    spark = local_session(cores, shuffle_partitions=8, app="bench")
    QUERIES["i8_by_day"](spark, folder).write.format("noop").mode("overwrite").save()  # warm up the session
    seconds: dict[str, float] = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    sf = os.path.basename(os.path.normpath(folder)).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
