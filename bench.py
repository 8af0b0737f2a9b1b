"""Time the headline queries, each from the source tables, and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from carepath.registry.queries import PREPARED, QUERIES  # noqa: E402
from carepath.session import drop_materialised, local_session  # noqa: E402

HEADLINES = [
    "sessionize",
    "merge_sessions",
    "sessions_with_billing",
    "select_population",
    "inclusion_funnel",
    "los_target",
    "rehospitalization",
    "mace",
    "prognosis",
    "event_cohort",
    "split_hospital",
    "split_temporal",
    "count_features",
    "decayed_features",
    "embedding_features",
    "random_projection",
    "cooccurrence",
    "ppmi",
    "code_embeddings",
    "nearest_codes",
    "temporal_heatmap",
    "describe_cohort",
    "binary_scores",
    "fit_logistic",
    "fit_forest",
    "fit_boosting",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINES
    spark = local_session(cores)
    spark.read.parquet(f"{folder}/orders.parquet").count()
    seconds = {}
    for name in names:
        # nothing prepared for another query is used
        PREPARED.clear()
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
        drop_materialised(spark)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
