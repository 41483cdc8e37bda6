"""Registered queries against their SQL twins on the smallest tables."""

import pytest

import __spark_entry__ as registered
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
# quick ones; `python -m tests.compare` runs every query
QUICK = [
    "s05_category_codes", "s13_open_tasks", "p01_stratified_split", "p02_stratified_folds", "p04_sample_with_replacement",
    "f02_label_noise_asymmetric", "f07_missing_mar", "f08_outliers", "c01_median_fill", "c04_neighbor_imputation", "c09_local_outlier_factor",
    "c15_edited_neighbors", "c17_synthetic_minority_nominal", "c18_random_oversampling", "st02_order_sensitivity_ties",
    "st09_permutation_test_coarse", "a01_score_matrix", "a02_complete_groups", "a10_collapse_noop_imputation", "a20_relabel_quality", "g03_expected_rows",
]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", QUICK)
def test_twin_agrees(spark, con, name):
    assert difference(registered.queries()[name](spark, FOLDER), con, registered.oracle_sql()[name]) is None


def test_every_twin_has_a_query():
    assert set(registered.oracle_sql()) <= set(registered.queries())


def test_flagship(spark):
    assert registered.entry(spark).count() == 3
