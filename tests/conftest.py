import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from chartweave.session import local_session  # noqa: E402
from chartweave.streaming.ledger import STATE_PROVIDER  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("chartweave-tests", 8, **{"spark.sql.streaming.stateStore.providerClass": STATE_PROVIDER})
    yield session
    session.stop()
