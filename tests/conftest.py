import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])
SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lodestar.session import local_session, ship_code

    session = local_session(4, partitions=4, memory="4g", **{"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"})
    ship_code(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not SF.exists():
        pytest.skip("no test tables")
    return str(SF)
