import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quire.session import local_session

    session = local_session(4, "tests", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("ckpt"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
