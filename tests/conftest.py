import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from consentry.queries import Frames  # noqa: E402
from consentry.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", shuffle_partitions=4)


@pytest.fixture(scope="session")
def frames(spark):
    return Frames(spark, SMALL)
