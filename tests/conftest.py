import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from orthant import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "tests")


@pytest.fixture
def vectors(spark):
    """Rows of a matrix as (id, x), spread over a given number of partitions."""

    def make(x, ids=None, parts=3):
        ids = range(len(x)) if ids is None else ids
        rows = [(int(i), [float(v) for v in r]) for i, r in zip(ids, x)]
        return spark.createDataFrame(rows, "id long, x array<double>").repartition(parts)

    return make
