from __future__ import annotations

import pytest

from civic_spark.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4, app="civic-spark-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """Build a DataFrame from a schema string and rows."""
    return lambda schema, *rows: spark.createDataFrame(list(rows), schema)


def dicts(df, *columns: str) -> list[dict]:
    return [r.asDict() for r in (df.select(*columns) if columns else df).collect()]
