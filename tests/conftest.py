import os
import tempfile

import pytest
from pyspark.sql import SparkSession

from wellstream.session import SESSION_CONF, STATE_STORE_CONF

os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    builder = (
        SparkSession.builder.master("local[*]")
        .appName("wellstream-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="wellstream-warehouse-"))
    )
    for key, value in {**SESSION_CONF, **STATE_STORE_CONF}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
