"""Registered queries against DuckDB.  GRATICULE_ALL=1 runs every query instead of one per family."""
import os

import pytest

import oracle
import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "A1_residualise", "A8_acf_radial_length", "A12_band_composition", "A19_directional_metrics", "A21_plane_fit_robust", "A29_compact_components", "A33_observe",
    "B1_cluster_bootstrap", "B6_perm_p", "B8_exact_signflip", "C2_expect_unique", "C6_expect_group_set", "C14_qc_flags", "D1_latin_hypercube", "D3_greedy_novelty",
    "G4_symmetric_graph", "G5_component_ids", "G5_connected_components", "G7_pair_typing", "J4_asof_nearest", "J12_best_shift", "J13_exact_repeat_pairs", "M1_group_kfold", "M8_select_alpha_inner",
    "M15_ablation", "P3_condition_key", "R1_fold_summary", "R9_correlations", "R11_partial_effects", "R21_auroc", "S9_seal_choices", "T1_top_k_per_group", "U3_set_jaccard",
    "W6_threshold_runs", "W10_min_spacing_select", "W12_threshold_width", "W13_section_features", "flagship_composition_by_label",
]


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("GRATICULE_ALL") else SAMPLE)
def test_query_matches_duckdb(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    note = oracle.differences(got, duck.execute(entry.oracle_sql()[name]).df())
    assert note is None or note.startswith("NEAR"), note


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() == 40 and df.columns[:2] == ["label", "coordinate"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
