"""Time the headline queries; prints one JSON line.

Every query runs in full (all rows, all columns) into the no-op sink. ``value`` is the sum of
the seconds; reading the tables and building the derived corpus is part of each query.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "tokenize_code",
    "noise_choose",
    "rw_choose_weighted",
    "sink_pairs",
    "rewrite_usage",
    "encode_pad",
    "length_stats",
    "ngrams",
    "bleu_corpus",
    "bleu_nltk",
    "ngram_recall_weighted",
    "bleu_smooth_sentence",
    "subtree_match",
    "dataflow_match",
    "codebleu",
    "metrics_by_group",
    "join_pred_gold",
    "join_clone_codes",
    "metric_summary",
    "wilcoxon_signed",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    from codeloom.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    from codeloom.plans.all import QUERIES

    # start-up of the JVM and the first code generation is not a query
    QUERIES["normalize_ws"](spark, sf).write.format("noop").mode("overwrite").save()
    seconds, build = {}, {}
    for name in names:
        start = time.perf_counter()
        df = QUERIES[name](spark, sf)
        df._jdf.queryExecution().executedPlan()
        build[name] = round(time.perf_counter() - start, 3)
        df.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]} (built in {build[name]})", file=sys.stderr, flush=True)
    out = {
        "metric": "headline queries, total seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "build": build,
        "sf": Path(sf).name,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
