import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

from tracksmith.session import Settings, build_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session(Settings(cores=4, memory="4g"), "tests", spark__sql__shuffle__partitions="4", spark__ui__showConsoleProgress="false", spark__sql__maxMetadataStringLength="5000")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA
