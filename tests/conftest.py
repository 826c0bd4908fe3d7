import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quillspark import session

    spark = session.build("tests", "local[4]", spark__driver__memory="6g", spark__sql__shuffle__partitions="4")
    spark.sparkContext.setLogLevel("OFF")
    yield spark
    spark.stop()
