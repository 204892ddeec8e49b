"""Headline timings over star tables; prints one JSON line.

The model is built once (raw tables -> checked, published tables), then the five panel views
run over it with three selections, and the case-level queries. Query figures are medians of
warm runs; ``model_build`` is the first, cold build.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame  # noqa: E402

from caselight import fixed_values as fv  # noqa: E402
from caselight.operators import cases, panels, profile  # noqa: E402
from caselight.operators.filters import FilterSpec  # noqa: E402
from caselight.plans.mart import build_model  # noqa: E402
from caselight.session import local_session  # noqa: E402
from caselight.sources.star_tables import raw_tables  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

SELECTIONS = {
    "all": {},
    "one_type": {"vax_types": ["MEDIUM"]},
    "broad_term": {"adhoc": [{"field": "SYMPTOMS", "op": "=", "value": "Brand#2"}]},
}


def seconds(run: Callable[[], object]) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def main() -> None:
    spark = local_session(CPUS, CPUS)
    times: dict[str, float] = {}
    # the bench runs on one machine, so its scratch model may live in a temporary folder
    target = tempfile.mkdtemp(prefix="caselight-bench-")
    raw = raw_tables(spark, FOLDER)
    start = time.perf_counter()
    mart = build_model(raw, spark, target)
    times["model_build"] = time.perf_counter() - start

    asked: dict[str, Callable[[], DataFrame]] = {}
    for selection, request in SELECTIONS.items():
        spec = FilterSpec.from_request(request)
        for name in fv.VIEWS:
            asked[f"view_{name}_{selection}"] = lambda s=spec, n=name: panels.named_view(mart, s, n)
    spec = FilterSpec.from_request(SELECTIONS["one_type"])
    asked["symptoms_significant"] = lambda: panels.panel(mart, spec, "symptoms")
    asked["has_data"] = lambda: panels.panel(mart, FilterSpec(), "has_data")
    asked["cases_first_page"] = lambda: cases.case_page(mart, spec, 25, 0)
    asked["cases_page_100"] = lambda: cases.case_page(mart, FilterSpec(), 25, 2475)
    asked["narrative_search"] = lambda: cases.case_total(mart, FilterSpec(query="eau"))
    asked["dossier"] = lambda: cases.dossier_submissions(mart, ["0000060"])
    asked["field_profiles"] = lambda: profile.field_profiles(mart)

    for name, ask in asked.items():
        def run() -> None:
            mart.forget_selections()  # nothing is carried over between runs
            ask().collect()  # every result is bounded: panels, pages, profiles

        run()  # warm-up
        times[name] = statistics.median(seconds(run) for _ in range(RUNS))

    print(json.dumps({
        "metric": "model build plus warm query medians",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": {name: round(t, 3) for name, t in times.items()},
        "sf": Path(FOLDER).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
