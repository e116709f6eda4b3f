import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from linktrove.plans.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("4", **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Value of a column expression over one row of named strings."""
    def run(build, **values):
        from pyspark.sql import functions as F

        names = list(values)
        ddl = ", ".join(f"{n} string" for n in names)
        df = spark.createDataFrame([tuple(values[n] for n in names)], ddl)
        return df.select(build(*[F.col(n) for n in names]).alias("v")).first()[0]

    return run
