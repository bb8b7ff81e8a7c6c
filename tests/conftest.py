import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))


@pytest.fixture(scope="session")
def spark():
    from pressgauge.session import build_session

    session = build_session("pressgauge-tests", 4, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
