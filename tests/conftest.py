import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from commitscope.session import get_spark
    s = get_spark("local[4]", app="commitscope-tests", shuffle_partitions=4)
    yield s
    s.stop()


def rows(df, *cols):
    """Collect selected columns as tuples (sorted for order-free checks)."""
    return [tuple(r) for r in df.select(*cols).collect()]
