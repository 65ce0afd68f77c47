import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from vigil.session import build_session

    ck = tempfile.mkdtemp(prefix="vigil-test-ckpt-")
    s = build_session("local[4]", 4, app_name="vigil-tests",
                      extra={"spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": ck})
    yield s
    s.stop()


@pytest.fixture
def tmp_dir():
    return tempfile.mkdtemp(prefix="vigil-test-")
