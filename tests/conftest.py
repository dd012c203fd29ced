import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pulsefleet.session import SEGMENT_ROWS, local_session  # noqa: E402

DATA = os.environ.get("PULSEFLEET_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("8")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture
def small_segments(spark):
    """Force the plans for heavy keys on small data."""
    spark.conf.set(SEGMENT_ROWS, "25")
    yield
    spark.conf.unset(SEGMENT_ROWS)
