import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
# the process that runs a streaming source beside the driver imports providers by name
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parent), sys.path[0], os.environ.get("PYTHONPATH", "")])

from sluicework.session import local_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # queries of a few rows are run once, so compiling them would take most of the time
    s = local_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"})
    s.sparkContext.setLogLevel("ERROR")
    return ship(s)


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF
