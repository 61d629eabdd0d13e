import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sparcel.session import local_session

    session = local_session(8)
    yield session
    session.stop()


def rows(df, *order):
    """Rows as sorted tuples."""
    cols = order or tuple(df.columns)
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
