import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import stand_ins  # noqa: E402
from pyspark import cloudpickle  # noqa: E402

# the workers get the stand-ins with the tasks
cloudpickle.register_pickle_by_value(stand_ins)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from examflow.session import get_session

    s = get_session("local[4]", app="examflow-tests", **{"spark.sql.shuffle.partitions": "8"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_small():
    return SF_SMALL


@pytest.fixture()
def scratch(spark):
    from examflow.session import scratch_path

    return lambda name="t": scratch_path(spark, name)
