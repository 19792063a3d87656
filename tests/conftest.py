import pytest

from loomline.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", cpus=4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    yield s
    s.stop()
