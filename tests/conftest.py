import tempfile

import pytest

from groundwork.session import session

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    made = session(
        "tests",
        **{
            "spark.master": "local[4]",
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-"),
            "spark.local.dir": tempfile.mkdtemp(prefix="spark-"),
        },
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def data():
    return DATA
