import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def redact(spark):
    """``redact(texts, mode=..., **config)``: result rows in input order."""
    from hushlake import SanitizeConfig, sanitize_table

    def run(texts, **settings):
        df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(2)
        out = sanitize_table(df, config=SanitizeConfig(**settings))
        return sorted(out.collect(), key=lambda r: r.id)

    return run
