from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from twinproof.session import local_session  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", 8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data() -> str:
    return DATA


@pytest.fixture(scope="session")
def con(data):
    import oracle

    return oracle.connect(data)


def rows(df, *columns):
    """Collected rows as a set of tuples."""
    return {tuple(r) for r in (df.select(*columns) if columns else df).collect()}


@pytest.fixture(scope="session")
def as_set():
    return rows
