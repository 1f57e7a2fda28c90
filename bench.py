"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Every query
runs once to warm up and then up to three times (fewer if slow); the median
counts. `index_build` writes a new index; the searches read the stored one.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rankweave.operators import knn, pq
from rankweave.plans.index import build_index
from workload import queries as w

NAMES = (
    "bm25_search", "keyword_search", "native_search", "fuzzy_search", "vector_search", "vector_search_cells",
    "hybrid_rrf", "hybrid_weighted", "score_breakdown", "retrieve_batch", "compare_strategies",
    "content_document", "enrich_join", "item_defaults", "metadata_unpack", "facet_year",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(run, times=3):
        run()
        seconds = []
        while len(seconds) < times and sum(seconds) < 5:
            start = time.perf_counter()
            run()
            seconds.append(time.perf_counter() - start)
        return round(statistics.median(seconds), 3)

    docs = w.documents(spark, sf_dir)
    results = {"index_build": timed(lambda: build_index(docs, {"content": F.col("text")}), 1)}
    for name in NAMES:
        results[name] = timed(lambda: {**w.QUERIES, **w.APPROXIMATE}[name](spark, sf_dir).collect())

    # Added this round: timed and reported beside the headline sum, which stays comparable.
    added = {name: timed(lambda: {**w.QUERIES, **w.APPROXIMATE}[name](spark, sf_dir).collect())
             for name in ("bm25_top_k", "vector_search_pq", "infix_indexed")}

    # An approximate search says how much it found and how much it looked at.
    exact = w.vector_search(spark, sf_dir).select("query_id", "doc_id")
    near = w.vector_search_cells(spark, sf_dir).select("query_id", "doc_id")
    recall = exact.join(near, ["query_id", "doc_id"]).count() / exact.count()
    cells = w.given_cells(spark, sf_dir)
    share = knn.scanned_share(cells, w.search_queries(spark, sf_dir), w.probes_of(cells))
    found = exact.join(w.vector_search_pq(spark, sf_dir).select("query_id", "doc_id"), ["query_id", "doc_id"]).count()
    index, asked = w.pq_index(spark, sf_dir), w.search_queries(spark, sf_dir).filter("query_vec IS NOT NULL")
    one = asked.orderBy("query_id").limit(10).toArrow()  # bytes of a search of one query, over ten of them
    shares = [pq.bytes_read(index, pq._candidates(index, one.slice(i, 1), w.PQ_RERANK))["share"] for i in range(one.num_rows)]
    block = pq.bytes_read(index, pq._candidates(index, asked.toArrow(), w.PQ_RERANK))["share"]
    print(json.dumps({
        "metric": "headline queries, warm median", "value": round(sum(results.values()), 3), "unit": "sec",
        "queries": results, "added_queries": added, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cells_recall": round(recall, 4), "cells_scanned_share": round(share, 4),
        "pq_recall": round(found / exact.count(), 4), "pq_bytes_share_one_query": round(statistics.mean(shares), 4),
        "pq_bytes_share_all_queries": round(block, 4),
    }))


if __name__ == "__main__":
    main()
