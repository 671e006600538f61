import pytest

from tablewright.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]",
        "tablewright-tests",
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
