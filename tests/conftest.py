import logging
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from evispark.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    logging.getLogger("DataFrameQueryContextLogger").setLevel(logging.CRITICAL)
    return build_session(
        "local[4]",
        4,
        **{
            "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
            "spark.driver.memory": "4g",
        },
    )


@pytest.fixture
def sf():
    return SF
