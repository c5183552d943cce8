import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from querytally.session import get_session

    session = get_session(
        "tests", "local[8]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__sql__maxMetadataStringLength=4000,
        spark__driver__memory="6g", spark__sql__warehouse__dir=tempfile.mkdtemp(prefix="wh-"),
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="ckpt-"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
