"""Registered queries against their DuckDB oracles on the smallest tables.
GROVE_FULL=1 runs every oracle (slower)."""

import os

import pytest

from conftest import SMALL
from oracle_harness import compare, duck
from grove.plans.catalog import ORACLES, QUERIES

FAST = ["prep_cast_numeric", "prep_parse_strings", "prep_string_index", "prep_one_hot",
        "batches_equal_holdout", "quantile_sample", "bag_weights", "value_counts",
        "splits_stride", "splits_unordered_subsets", "class_histogram", "split_gains",
        "best_split_continuous", "tree_nodes", "forest_nodes", "forest_predictions",
        "column_summary", "logistic_score", "roc_curve", "tree_fates", "update_forest",
        "column_summary_merged", "joint_label_histogram", "tree_rules",
        "update_fates", "add_trees", "stream_update", "grid_kept_and_grown", "stream_versions"]
NAMES = sorted(ORACLES) if os.environ.get("GROVE_FULL") else FAST


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    ok, n, _, _, detail = compare(spark, con, name, QUERIES[name], ORACLES[name], SMALL)
    assert ok, detail
