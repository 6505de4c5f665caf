import os
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 4g --conf spark.ui.showConsoleProgress=false pyspark-shell")

import pytest

from tidemark.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
