import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from opinionmill import schema as S  # noqa: E402
from opinionmill.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "local[4]", 4, spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="opinionmill-tests-"))
    yield session
    session.stop()


@pytest.fixture
def make_opinions(spark):
    """Opinions from (product, text, category, polarity[, time]) tuples, in order."""
    def make(rows):
        full = [
            (i, r[0], r[1], r[2], r[2], r[3], r[4] if len(r) > 4 else "")
            for i, r in enumerate(rows)
        ]
        return spark.createDataFrame(full, S.OPINIONS)

    return make
