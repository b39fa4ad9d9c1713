import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from commitlens.session import local_session  # noqa: E402
from commitlens.sources.fixture import fixture_charges  # noqa: E402

TESTDATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        cores=8,
        memory="8g",
        spark__local__dir=str(tmp_path_factory.mktemp("spark-local")),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return str(TESTDATA / "sf0.01")


@pytest.fixture(scope="session")
def charges(spark, sf_dir):
    """The fixture charge table at sf0.01."""
    return fixture_charges(spark, sf_dir)


@pytest.fixture(scope="session")
def stored_charges(spark, charges, tmp_path_factory):
    """Directory of the fixture written as Parquet, so that scans of a charge table can be seen."""
    path = str(tmp_path_factory.mktemp("charges") / "focus")
    charges.repartitionByRange(4, "ChargePeriodStart").sortWithinPartitions(
        "ChargePeriodStart"
    ).write.parquet(path)
    return path
