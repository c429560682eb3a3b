import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidewater.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def values(df, *cols):
    """Rows as sorted tuples."""
    rows = [tuple(r[c] for c in cols) if cols else tuple(r) for r in df.collect()]
    return sorted(rows, key=lambda t: tuple((v is not None, v if v is not None else 0) for v in t))
