from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from panelforge.session import build_session

    s = build_session("local[4]", shuffle_partitions=4,
                      checkpoint_dir=tempfile.mkdtemp(prefix="pf-test-ckpt-", dir="/tmp"))
    yield s
    s.stop()


def rows(df, *cols):
    """Collected rows as tuples (in ``cols`` order), sorted."""
    cols = cols or tuple(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
