"""Each query against its SQL on sf0.001."""

import pytest

from tests.compare import database, differences
from textloom import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(SF)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, db, name):
    df = catalogue.queries()[name](spark, SF)
    if name in catalogue.oracle_sql():
        assert differences(df, db, catalogue.oracle_sql()[name]) is None
    else:
        df.collect()
