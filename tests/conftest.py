from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from turnwise.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 8, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """The rows of a frame as sorted tuples, floats rounded."""

    def collect(df, digits=9):
        plain = [
            tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in df.collect()
        ]
        return sorted(plain, key=repr)

    return collect
