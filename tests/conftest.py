import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from postrisk.session import get_spark
    s = get_spark("local[4]", app="postrisk-tests", shuffle_partitions=8,
                  extra={"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"})
    # tests have no cluster-provided shared folder: use a private one
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="postrisk-test-ckpt-"))
    yield s
    s.stop()


SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
