import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from flowlens.session import get_spark
    s = get_spark(master="local[4]", shuffle_partitions=4, app="flowlens-tests")
    yield s
    s.stop()


def rows(df, *cols):
    """Collect as sorted tuples (None sorts first)."""
    sel = df.select(*cols) if cols else df
    out = [tuple(r) for r in sel.collect()]
    return sorted(out, key=lambda t: tuple((x is not None, x) for x in t))
