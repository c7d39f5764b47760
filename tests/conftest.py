import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sparkwarden import prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return prepare(session)


@pytest.fixture
def corpus(spark):
    def make(files: dict[str, str], root: str = "/srv/p"):
        rows = [(root, f"{root}/{path}", text) for path, text in files.items()]
        return spark.createDataFrame(rows, "root STRING, file_path STRING, content STRING")

    return make
