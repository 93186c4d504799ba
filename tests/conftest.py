import pytest
from pyspark.sql import SparkSession

from panelloom.sources.sinks import clear_staged


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[8]")
        .appName("panelloom-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("staged")))
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear_staged(session)
    session.stop()


def rows(df, *columns):
    """Rows as plain tuples in a stable order, missing values last."""
    names = columns or df.columns
    out = [tuple(r[c] for c in names) for r in df.collect()]
    return sorted(out, key=lambda t: tuple((v is None, v if v is not None else 0) for v in t))
