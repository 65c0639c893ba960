import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from webtraj.session import build_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"

# Started before the test modules are imported: they build columns at module level.
SESSION = build_session("tests", "local[8]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                        spark__sql__shuffle__partitions="8", spark__driver__memory="4g",
                        spark__python__sql__dataFrameDebugging__enabled="false")
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate columns over one text column ``r`` and return plain tuples."""
    def run(texts, *columns):
        df = spark.createDataFrame([(t,) for t in texts], "r string")
        return [tuple(row) for row in df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()]

    return run
