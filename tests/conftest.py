import pytest

from tidewatch.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
           "spark.driver.memory": "6g", "spark.sql.adaptive.coalescePartitions.enabled": "true"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def small_groups(spark):
    """Treat any key with more than 6 rows as hot, so the segmented path runs."""
    spark.conf.set("spark.tidewatch.maxRowsPerGroup", "6")
    yield
    spark.conf.unset("spark.tidewatch.maxRowsPerGroup")
