"""Time the headline queries; prints one JSON line.

Data: $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS].
A query's time covers building its plan and computing every output column.
"""

import json
import os
import sys
import time

from docgauge.plans import load
from docgauge.session import local_session

HEADLINE = [
    "detect_type", "normalize_text", "html_to_text",
    "core_completeness", "core_validity", "core_consistency", "core_accuracy", "core_timeliness", "core_uniqueness",
    "table_completeness", "table_sum_consistency", "table_uniqueness", "table_accuracy_ref", "contract_clauses",
    "invoice_amounts_of_orders", "json_type_validation", "json_records_profile", "social_language", "social_spam",
    "tab_type_consistency", "markup_tags", "email_body", "gen_readability", "gen_keywords", "proto_json",
    "issues_by_metric", "evaluate_invoices", "evaluate_documents",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, name="bench")
    catalog = load()
    names = sys.argv[1:] or HEADLINE
    # start the JVM's and Python's lazy parts before timing
    catalog.QUERIES["label_lookups"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
