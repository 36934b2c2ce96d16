"""Headline timings: runs the flagship and the other headline queries at $BENCH_SF_DIR on
local[$BENCH_CPUS] and prints ONE JSON line.

Each query runs twice in one session; ``queries`` has the second run, ``first_run`` the first. Each is fully executed with the ``noop`` sink (every row computed, nothing collected).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["classify_table", "ensemble_average", "score_languages", "batch_progress", "history_pages_all_users",
            "clean_text", "job_status_live"]


def classify_apply_only(spark, sf_dir: str) -> float:
    """The flagship with its models, language profiles and translation table trained beforehand
    (the reference's models are pretrained): labelling cost alone. Reported, not summed."""
    from verba.operators import language as L
    from verba.operators import models as M
    from verba.plans import classify as C
    from verba.sources import tables as TB

    docs = TB.cleaned_documents(spark, sf_dir)
    models = M.train_task_models(spark, sf_dir, "spam", cleaned_docs=docs)
    lang = L.language_profiles(spark, sf_dir, cleaned_docs=docs)
    tr = TB.translations(spark, sf_dir, docs)
    raw = TB.load(spark, sf_dir, "documents")
    t0 = time.time()
    C.classify_table(spark, sf_dir, raw, models=models, lang_model=lang, translations=tr) \
        .write.format("noop").mode("overwrite").save()
    return round(time.time() - t0, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from verba.plans import catalog
    from verba.session import get_spark

    spark = get_spark(master=f"local[{cpus}]")
    spark.range(1000).selectExpr("sum(id)").collect()  # session start-up is not a query's cost
    qs = catalog.queries()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in qs]
    times = {}
    first = {}
    for name in names:
        for into in (first, times):  # twice: the first run also pays for compilation and worker start-up
            t0 = time.time()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            into[name] = round(time.time() - t0, 3)
    if not sys.argv[1:]:
        times["classify_apply_only"] = classify_apply_only(spark, sf_dir)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    total = sum(v for k, v in times.items() if k != "classify_apply_only")
    print(json.dumps({"metric": "headline_total", "value": round(total, 3), "unit": "sec",
                      "queries": times, "first_run": first, "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
