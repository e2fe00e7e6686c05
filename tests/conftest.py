import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from lectern.session import local_session, ship

    session = local_session(8, 8, "8g")
    session.sparkContext.setLogLevel("ERROR")
    yield ship(session)
    session.stop()
