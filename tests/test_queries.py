"""Every registered query against its SQL on the small tables."""

import oracle
import pytest

import workload

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", list(workload.RUNS))
def test_query(spark, con, name):
    assert oracle.compare(spark, con, FOLDER, workload.RUNS[name], workload.SQL.get(name)) is None
