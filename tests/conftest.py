import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from reachlens.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return build_session(
        "tests", 8, spark__sql__shuffle__partitions="4", spark__sql__maxMetadataStringLength="2000"
    )


@pytest.fixture(scope="session")
def small():
    return SMALL
