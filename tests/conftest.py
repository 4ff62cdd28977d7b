import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tablekeeper.session import get_spark
    s = get_spark("local[*]", 8, app="tablekeeper-tests")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tk-test-ckpt-"))
    yield s
    s.stop()
