import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("stepledger-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=["cores", "pieces"])
def heavy(request, spark):
    """Runs a test twice: in one range for each core, and with the rows cut in seven, through their groups."""
    if request.param == "pieces":
        spark.conf.set("spark.stepledger.pieces", "7")
    yield request.param
    spark.conf.unset("spark.stepledger.pieces")


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
