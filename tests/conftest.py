from __future__ import annotations

import os

import pytest

from parcelmart.session import build_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="6g",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(SMALL):
        pytest.skip("test tables are not here")
    return SMALL


def rows(df, *order):
    """Rows as tuples in a stable order."""
    found = [tuple(r) for r in df.collect()]
    return sorted(found, key=repr) if not order else found
