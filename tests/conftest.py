import os
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent
# workers import the package and the test modules' helpers
os.environ["PYTHONPATH"] = os.pathsep.join([str(HERE.parent), str(HERE), str(HERE / "llm"), os.environ.get("PYTHONPATH", "")])

from quarryspark.runtime import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", partitions=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def values(spark):
    """values(f, list, kind): what an expression gives for each value."""

    def run(f, rows, kind="string"):
        return [r[0] for r in spark.createDataFrame([(r,) for r in rows], f"x {kind}").select(f("x").alias("y")).collect()]

    return run
