"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

import pytest
from compare import both, duck

from tideglass.plans import catalog
from tideglass.plans.catalog import ORACLE

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_rows_match_sql(spark, con, name):
    columns, names, got, want = both(spark, con, catalog.QUERIES[name], ORACLE[name], FOLDER)
    assert columns == names and got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(ORACLE)))
def test_other_queries_give_rows(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0


def test_as_of_needs_no_join(spark):
    plan = catalog.w20_as_of(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan


def test_scans_read_only_what_they_need(spark):
    plan = catalog.q04_serving_progress(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_tax" not in plan and "l_quantity" not in plan
