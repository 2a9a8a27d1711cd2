import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from rosterlake.session import clear_written, local_session

    session = local_session("8", 4)
    yield session
    clear_written(session)


@pytest.fixture(scope="session")
def warehouse(spark):
    from rosterlake.plans.warehouse import warehouse as open_warehouse

    return open_warehouse(spark, SMALL)
