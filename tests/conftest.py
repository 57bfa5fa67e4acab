import sys
from pathlib import Path

import pytest
from hypothesis import settings

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from frameloom.session import local_session  # noqa: E402

settings.register_profile("steady", deadline=None)
settings.load_profile("steady")


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
