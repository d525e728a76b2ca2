import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
# Python workers load functions of test modules by name
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT / "tests"), os.environ.get("PYTHONPATH", "")])
DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lectern.session import build_session, prepare

    session = build_session("local[8]", "tests", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


@pytest.fixture
def rows(spark):
    """Rows of literals as a DataFrame."""
    return lambda data, schema: spark.createDataFrame(data, schema)


def data_folder(scale: str) -> str:
    folder = DATA / scale
    if not folder.exists():
        pytest.skip(f"no test data for {scale}")
    return os.fspath(folder)
