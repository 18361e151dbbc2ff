import pytest


@pytest.fixture(autouse=True, scope="package")
def few_partitions(spark):
    """The operators run many small jobs on these fixtures; fewer tasks each keep the tests short."""
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")
