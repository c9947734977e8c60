"""Every named query against its SQL oracle on the small tables, plus a check of the plan's shape."""

import pytest

from fleetsight.plans.catalog import ORACLES, QUERIES
from tools.check_oracles import compare, connect

from conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, rows, message = compare(con, spark, name, SMALL)
    assert ok, message
    if name not in ORACLES:
        assert rows > 0


def test_only_model_fits_lack_an_oracle():
    assert {n for n in QUERIES if n not in ORACLES} == {
        "m02_isolation_forest",
        "m02_isolation_forest_embeddings",
        "m03_kmeans_clusters",
        "m06_scoring_cycle_model",
    }
