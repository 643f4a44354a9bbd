import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tools.local import local_spark
    s = local_spark("*")
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir(spark):
    from promptforge.session import scratch_dir
    p = scratch_dir(spark, "test")
    return p[len("file:"):] if p.startswith("file:") else p
