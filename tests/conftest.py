import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortile.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shared"))
    s = build_session("tests", cpus=4, **{"spark.checkpoint.dir": folder})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
