import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flowquarry.session import get_spark, release  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", 4, **{"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    release(s)


def rows(df):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((x is None, str(x)) for x in t))
