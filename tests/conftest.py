import pytest

from codeloom.session import make_session


@pytest.fixture(scope="session")
def spark():
    """Plans as in production (adaptive execution), but with two shuffle partitions and without compiling each."""
    session = make_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.default.parallelism": "4", "spark.sql.codegen.wholeStage": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
