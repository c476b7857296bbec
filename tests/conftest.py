import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sparrowlog.session import session

    folder = tmp_path_factory.mktemp("spark")
    s = session("local[4]", spark__sql__shuffle__partitions="4", spark__checkpoint__dir=f"file://{folder}/shared", spark__sql__warehouse__dir=f"{folder}/warehouse", spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
