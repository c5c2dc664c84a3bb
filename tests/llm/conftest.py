import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)
    return make


@pytest.fixture(scope="session")
def rows_of():
    def rows(df, *columns):
        return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    return rows
