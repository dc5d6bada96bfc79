"""Every registered query against its SQL twin, on the smallest tables."""

import os

import pytest

from testbed.compare import compare, duck
from testbed.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no generated tables")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    _, problem = compare(spark, con, name, FOLDER)
    assert problem is None


def test_only_fitted_models_lack_sql():
    assert set(QUERIES) - set(SQL) == {"baseline_model_scores"}
