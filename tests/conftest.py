import os

import pytest
from pyspark.sql import SparkSession

DATA = os.environ.get("CITEGROVE_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA


RECORD = "rec_id long, authors string, title string, year int, source string, keywords string, abstract string, citations long, doi string, refs string, origin string, language string, language_source string, is_oa boolean, oa_url string, ipc string, harvested_at timestamp"


@pytest.fixture(scope="session")
def make_records(spark):
    """Records from dicts; columns not given are null, rec_id counts from 1. An extra column clashes with names used inside."""

    def make(*rows):
        names = [c.split()[0] for c in RECORD.split(", ")]
        full = [tuple({"rec_id": i, **r}.get(n) for n in names) + ("clash",) for i, r in enumerate(rows, 1)]
        return spark.createDataFrame(full, RECORD + ", field string")

    return make
