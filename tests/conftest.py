import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import session

    s = session(
        "tests", "local[8]", spark__sql__shuffle__partitions=4, spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g", spark__python__sql__dataFrameDebugging__enabled="false",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()

