import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from modlens import analyze, schemas  # noqa: E402
from modlens.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def modules(spark):
    """Modules from a dict of texts."""

    def make(texts):
        rows = [(name, f"/src/{name}.sql", "s1", sql) for name, sql in texts.items()]
        return spark.createDataFrame(rows, schemas.MODULES).coalesce(1)

    return make


@pytest.fixture(scope="session")
def traces(modules):
    """Collected traces by module id."""

    def run(texts, config=None):
        return {r.module_id: r for r in analyze(modules(texts), config).collect()}

    return run
