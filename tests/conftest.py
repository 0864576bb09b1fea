import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def shared_folder(tmp_path_factory):
    return str(tmp_path_factory.mktemp("shared"))


@pytest.fixture(scope="session")
def spark(shared_folder):
    from folioflow.session import local_session
    from folioflow.streaming.playback import ROCKSDB

    session = local_session(
        4,
        **{
            "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
            "spark.checkpoint.dir": shared_folder,
        },
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL
