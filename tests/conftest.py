import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tidewright.session import clear_scratch, local_session

    session = local_session("4", "tidewright-tests")
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewright-ckpt-"))
    yield session
    clear_scratch(session)
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def formatted_plan(df):
    """The physical plan with whole file scans; the short form cuts their details."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
