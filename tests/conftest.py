import os
import sys

os.environ.setdefault("TAGWEAVE_DRIVER_MEMORY", "3g")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pytest

from tagweave.plans.runtime import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


def rows(df):
    """Rows as plain tuples, in any order."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
