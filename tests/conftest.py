import pytest

from passagework.session import get_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session("local[8]", 4, **{"spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
