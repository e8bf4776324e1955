import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidegrid.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.default.parallelism": "2", "spark.sql.sources.parallelPartitionDiscovery.threshold": "1000",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def day():
    return dt.date.fromisoformat


@pytest.fixture
def frame(spark):
    """frame("date date, gy int", rows): dates may be given as ISO text."""

    def make(ddl, rows):
        kinds = [part.strip().split(" ", 1)[1] for part in ddl.replace(", ", ",").split(",")]
        if "<" in ddl:
            return spark.createDataFrame(rows, ddl)
        fixed = [
            tuple(dt.date.fromisoformat(v) if k == "date" and isinstance(v, str) else v for v, k in zip(r, kinds))
            for r in rows
        ]
        return spark.createDataFrame(fixed, ddl)

    return make


def rows_of(df, *order):
    out = [tuple(r) for r in df.select(*order).collect()]
    return sorted(out, key=lambda r: [(v is None, str(v)) for v in r])
