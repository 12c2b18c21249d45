import os
import tempfile

import pytest

from strataforge.session import build_session


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="strataforge-test-")}
    s = build_session("tests", os.environ.get("TEST_MASTER", "local[8]"), **conf)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
