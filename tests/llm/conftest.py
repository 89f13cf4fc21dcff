import pytest

from modlens.session import ship_package

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True, scope="session")
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows, in several partitions."""

    def make(rows, partitions=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
        return spark.createDataFrame(full, DOCUMENT).repartition(partitions)

    return make
