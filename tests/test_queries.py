"""Every registered query with a DuckDB twin must agree with it on the smallest tables; the others must run."""

import pytest

import __spark_entry__ as entry
import oracle
from evidence_spark.plans import load_all

ROOT = "/root/testdata/sf0.001"
SLOW = {"train_text_models", "word_char_union", "bake_off", "grid_search", "shuffled_label_test"}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(ROOT)


@pytest.mark.parametrize("name", [n for n in load_all() if n not in SLOW])
def test_query(spark, con, name):
    ok, note = oracle.compare(spark, con, ROOT, load_all()[name])
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
