import os
import sys

import pytest
from pyspark import SparkConf

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quernstone.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    # Only where the machine's own settings name no folder.
    folder = {} if SparkConf().get("spark.checkpoint.dir") else {"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    s = build_session("tests", "local[4]", **folder, **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.log.level": "ERROR", "spark.driver.memory": "6g",
    })
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
