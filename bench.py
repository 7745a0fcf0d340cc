"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

The session is warmed up on the smallest data set next to the measured one, so
that class loading and the start of the Python workers are not counted."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = [
    "mail_features_wide", "url_agg", "url_agg_rows", "url_typosquat", "hdr_mismatch", "att_flags",
    "txt_structure", "txt_lexicon", "txt_patterns", "txt_evidence", "class_balance", "stratified_split", "shuffle_renumber",
    "gen_mail", "top_signals", "soc_fusion", "ver_domain", "ver_token_content", "reg_enroll",
    "med_crop_box", "med_segments", "med_verdict", "incident_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINES

    from baitwatch.plans.queries import QUERIES
    from baitwatch.session import build_session

    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 12g pyspark-shell")
    spark = build_session("baitwatch-bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    # Each input file is one row group here, which Spark can't split by itself.
    spark.conf.set("baitwatch.input.partitions", cpus)
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm_dir):
        QUERIES["mail_features_wide"](spark, warm_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
