import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from sightline.session import local_session

    session = local_session("4", "tests", partitions=4)
    yield session
    session.stop()


def rows(df, *order):
    """Rows as tuples, sorted by ``order`` or by all columns."""
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]
