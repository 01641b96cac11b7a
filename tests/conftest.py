import pytest

from plumbline.session import session, ship


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session("local[4]", 4, **{"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"})
    ship(spark)
    yield spark
    spark.stop()
