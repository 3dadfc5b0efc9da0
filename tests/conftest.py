import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barflow.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(os.environ.get("BARFLOW_TEST_CPUS", "8"), "barflow-tests")
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="barflow-test-"))
    yield s


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("BARFLOW_TEST_SF", "/root/testdata/sf0.001")
