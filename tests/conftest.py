import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from postern import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session.build(
        "local[4]",
        **{"spark.ui.enabled": "false", "spark.log.level": "ERROR", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"},
    )
    yield s
    s.stop()
