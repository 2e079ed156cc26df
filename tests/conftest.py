import pytest

from quillspark.session import session, ship_package


@pytest.fixture(scope="session")
def spark():
    made = session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    made.sparkContext.setLogLevel("ERROR")
    ship_package(made)
    return made
