"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and
BENCH_QUERIES (comma-separated names, default the list below) set the run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "lex_term_df", "bm25_top20", "bm25_postings_top20", "bm25_postings_phrases", "dense_top20", "dense_cells_top20",
    "hash_embed", "mode_dense", "mode_bm25", "mode_rrf",
    "rerank_top5", "cascade_hits", "normalize_text", "sections", "html_blocks", "md_blocks", "csv_rows",
    "pack_windows_overlap", "chunk_parents", "chunk_children", "page_chrome", "manifest_skip", "cache_join",
    "latency_p50", "eval_rollup", "stream_ingest_search",
)


def main() -> None:
    from passagemill.plans import registry
    from passagemill.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(
        os.environ.get("BENCH_CPUS", "8"), "passagemill-bench",
        **{"spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    queries = registry.queries()
    spark.read.parquet(f"{sf_dir}/documents.parquet").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    scale = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale) if scale.replace(".", "").isdigit() else scale,
    }))


if __name__ == "__main__":
    main()
