import pytest

from rivulet.session import get_spark


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = get_spark(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('checkpoints')}",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
