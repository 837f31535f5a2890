import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from leadwake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("leadwake-tests", "8", 4)
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
