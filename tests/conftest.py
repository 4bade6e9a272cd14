import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rowloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    import os

    os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parents[1]), os.environ.get("PYTHONPATH", "")])
    session = local_session(cores=8, shuffle_partitions=4, memory="6g")
    yield session
    session.stop()
