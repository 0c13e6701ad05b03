import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))


@pytest.fixture(scope="session")
def spark():
    from wattframe.session import build_session

    s = build_session("tests", "local[8]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
                      spark__driver__memory="8g", spark__sql__codegen__wholeStage="false")  # compiling costs more than these small tables
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
