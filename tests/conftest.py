import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from tomeweave.session import prepare
    session = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
               .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
               .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    session.sparkContext.setLogLevel("OFF")
    yield prepare(session)


@pytest.fixture
def apply(spark):
    """Evaluate one column function over literal rows of strings."""
    from pyspark.sql import functions as F

    def run(function, *rows):
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        names = [f"c{i}" for i in range(len(rows[0]))]
        data = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} string" for n in names))
        out = data.select("i", function(*[F.col(n) for n in names]).alias("o")).orderBy("i").collect()
        return [r["o"] for r in out]

    return run
