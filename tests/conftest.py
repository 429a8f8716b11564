import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def trial_frame(spark):
    """Plots of a field trial: two varieties, of which the later label comes first; a yield before and after, and a day.

    Finite yields before are the whole numbers from 2 to 13; one is infinite, one missing. After is 1.5 more wherever
    before is known, and missing once.
    """
    before = [2.0, 5.0, 3.0, float("inf"), 6.0, 4.0, None, 8.0, 10.0, 7.0, 9.0, 11.0, 13.0, 12.0]
    after = [None if i == 4 else 20.0 if i in (3, 6) else b + 1.5 for i, b in enumerate(before)]
    rows = [(100 + i, "red" if i < 8 else "blue", before[i], after[i], f"2031-07-{2 * i + 1:02d}") for i in range(14)]
    frame = spark.createDataFrame(rows, "plot_id int, variety string, before double, after double, day string")
    return frame.withColumn("day", frame["day"].cast("timestamp"))
