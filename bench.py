"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and three times more; the median counts. Results
are forced with the noop sink.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from plumbline.plans.registry import queries
from plumbline.session import local_session

HEADLINE = (
    "t1_f14_f15_f53_hybrid_rank", "a8_t17_t18_adaptive_trust", "t2_bm25_topk", "s1_vector_topk", "j2_two_hop", "f13_g1_g4_graph_candidates", "t6_trust_ranking", "a3_a4_a9_a11_claim_metrics",
    "a12_noisy_or", "a40_j12_u52_u56_u57_evidence_scores", "w8_quota_interleave", "d7_dedup_folded_text", "u6_extract_sentences", "u71_u73_sentence_facts", "st5_st6_st7_f54_domain_blocks", "s7_log_query",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", int(os.environ.get("BENCH_CPUS", "4")))
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            start = time.time()
            queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        took[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "total_warm_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
