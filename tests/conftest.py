from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from vigil.session import get_session, ship

    session = get_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session


@pytest.fixture(scope="session")
def sf() -> str:
    return "/root/testdata/sf0.001"
