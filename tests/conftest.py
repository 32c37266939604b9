import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marketlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    s = build_session(
        "local[4]",
        app_name="marketlens-tests",
        shuffle_partitions=4,
        extra={
            "spark.sql.warehouse.dir": os.path.join(scratch, "warehouse"),
            "spark.driver.memory": "4g",
        },
    )
    # Use the configured checkpoint folder; set a scratch one only if unset.
    if not s.sparkContext.getCheckpointDir():
        configured = s.conf.get("spark.checkpoint.dir", None)
        s.sparkContext.setCheckpointDir(configured or os.path.join(scratch, "checkpoints"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def seed(spark):
    from tests.seed import seed_tables

    return seed_tables(spark)


@pytest.fixture()
def scratch_dir():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")
