"""Headline timings: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select data and cores.
Every query is executed in full (all columns, written to the no-op sink).
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = [
    "flagship_composition_by_label", "A33_observe", "A3_ranges", "A5_gradient_stats", "A8_acf_radial_length", "A19_directional_metrics",
    "J1_star_join", "J4_asof_nearest", "W6_threshold_runs", "W8_plateau_run", "R1_fold_summary", "R9_correlations", "R16_oof_metrics", "R26_hotspots",
    "G4_knn", "G7_pair_typing", "G5_connected_components",
    "B1_cluster_bootstrap", "B2_paired_component_interval", "B6_perm_p", "B8_exact_signflip",
    "M1_group_kfold", "M7_ridge_oof", "M8_select_alpha_inner", "M9_gam", "M11_residual_stack", "M12_tree_regressor_cv", "M15_ablation_groups",
    "D1_latin_hypercube", "S9_seal_choices",
]
PERMUTATIONS = 10_000  # replicates of the keyed tests; the registered twins, checked by DuckDB, take fewer

TREES = 300  # of each of five designs and five folds; the registered query takes fewer.  Minutes long: runs only when named


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from graticule.session import build_session
    spark = build_session(cpus, partitions=int(cpus))
    from graticule.catalog import REGISTRY, models, resampling
    from graticule.catalog.registry import Tables

    full = {f"{n}_{PERMUTATIONS}": fn for n, fn in (("B6_perm_p", resampling.perm_p_keyed), ("B7_tv_perm_p", resampling.tv_perm_p_keyed), ("B9_moran_perm_p", resampling.moran_perm_p_keyed), ("B10_auroc_perm_p", resampling.auroc_perm_p_keyed))} | {"B14_logistic_perm_2000": lambda t, _: resampling.logistic_perm(t, 2000), f"M12_matched_trees_{TREES}": lambda t, _: models.matched_trees(t, TREES)}
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor before timing
    only = sys.argv[1:]
    seconds = {}
    for name in only or [*HEADLINES, *(n for n in full if not n.startswith("M12"))]:
        started = time.perf_counter()
        result = full[name](Tables(spark, folder), PERMUTATIONS) if name in full else REGISTRY[name].run(spark, folder)
        result.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline query wall time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
