"""Headline-query benchmark.

/root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and prints one JSON line.
Every query is forced through the ``noop`` sink, so all of its columns are
computed (a ``count()`` would let the optimizer prune the text work away).
Each query runs once to warm up (JIT, Python workers); the best of two timed
runs is reported.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


from mailsift.functions import text as X  # noqa: E402
from mailsift.plans.registry import queries  # noqa: E402
from mailsift.session import get_spark  # noqa: E402
from mailsift.sources import tables as tb  # noqa: E402

HEADLINE = [
    "cln13_clean_text", "fea1_vocabulary", "fea1_vocabulary_cleaned", "fea2_encode_ids",
    "shp3_balance_classes", "agg6_class_unique_words", "evl9_evaluation_report",
]


def clean_documents(spark, d):
    """CLN-13 over every document (not only the labelled ones)."""
    docs = tb.load(spark, d, "documents")
    return docs.select("doc_id", X.clean_text("text").alias("text"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(f"local[{cpus}]", app="mailsift-bench", shuffle_partitions=max(8, 2 * cpus))
    qs = queries()
    jobs = [(n, qs[n]) for n in HEADLINE] + [("cln13_clean_documents", clean_documents)]
    times, rows = {}, {}
    for name, fn in jobs:
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        best = float("inf")
        for _ in range(2):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - t0)
        times[name] = round(best, 3)
    n_docs = tb.load(spark, sf_dir, "documents").count()
    n_mail = tb.mail(spark, sf_dir).count()
    rows["cln13_clean_documents"] = round(n_docs / times["cln13_clean_documents"], 1)
    rows["cln13_clean_text"] = round(n_mail / times["cln13_clean_text"], 1)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total_wall", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "rows_per_sec": rows, "sf": float(sf) if sf else None, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
