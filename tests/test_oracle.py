"""Every query with an SQL counterpart gives the same rows; the others give rows."""

import pytest

from cohortframe.plans import catalog
from compare import compare, connect

ORACLES = catalog.oracle_sql()
# fits on the very small cohorts of sf0.001 leave too few degrees of freedom for the SQL t series
LARGER = {"mdl_ols_by_group", "mdl_spec_grid", "mdl_wls_hc2"}


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - LARGER))
def test_matches_sql(spark, con, folder, name):
    assert compare(spark, con, catalog.queries()[name], ORACLES[name], folder) is None


@pytest.mark.parametrize("name", sorted(LARGER))
def test_matches_sql_on_more_rows(spark, name):
    folder = "/root/testdata/sf0.01"
    assert compare(spark, connect(folder), catalog.queries()[name], ORACLES[name], folder) is None


def test_every_query_is_registered_once():
    assert len(catalog.queries()) >= 125
    assert set(ORACLES) <= set(catalog.queries())
