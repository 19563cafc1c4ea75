"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortframe.operators import classes, specs  # noqa: E402
from cohortframe.plans import catalog  # noqa: E402
from cohortframe.plans.fixtures import Data  # noqa: E402
from cohortframe.plans.iterative_queries import class_moments  # noqa: E402
from cohortframe.plans.model_queries import GRID, study_stack  # noqa: E402
from cohortframe.session import local_session  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
IMPUTATIONS = int(os.environ.get("BENCH_IMPUTATIONS", "4"))

NAMED = [
    "mdl_ols_by_group", "rsh_wide_to_long", "rsh_long_to_wide", "join_merge_1to1", "win_percent_rank", "win_score_bundle",
    "agg_table_one", "agg_quantile", "agg_kde", "mdl_wls_hc2", "mdl_mnar_delta", "mdl_pca_scores", "mdl_bootstrap",
    "mdl_pseudo_class_draws",
]


def noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def spec_grid(spark):
    noop(specs.pooled_curve(specs.spec_curve(study_stack(Data(spark, FOLDER), IMPUTATIONS), GRID)))


def latent_growth_iteration(spark):
    """Seconds per EM pass over all class counts 1..5, after the person moments are staged."""
    moments = class_moments(Data(spark, FOLDER))
    start = time.time()
    classes.class_models(moments, 5, cycles=3, tolerance=0.0)
    return (time.time() - start) / (2 * (3 * 3 + 1))


def main() -> None:
    spark = local_session(CPUS, partitions=int(CPUS))
    noop(spark.range(1000))
    times: dict[str, float] = {}
    registered = catalog.queries()
    for name in NAMED:
        start = time.time()
        noop(registered[name](spark, FOLDER))
        times[name] = round(time.time() - start, 3)
    start = time.time()
    spec_grid(spark)
    times[f"mdl_spec_grid_m{IMPUTATIONS}"] = round(time.time() - start, 3)
    times["mdl_latent_growth_pass"] = round(latent_growth_iteration(spark), 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
