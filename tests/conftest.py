import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from millrace.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    session = local_session(
        8, 8, spark__sql__warehouse__dir=str(folder / "warehouse"), spark__checkpoint__dir=str(folder / "checkpoints")
    )
    yield session
    session.stop()
