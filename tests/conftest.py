import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from rillwork.functions.session import session

    conf = {
        "spark.master": "local[4]", "spark.driver.memory": "3g", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    }
    s = session("tests", **conf)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
