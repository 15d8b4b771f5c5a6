import pytest

from folioscan.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        # Groups of this size count as hot, and tiny partitions stay apart: both ways are used.
        "spark.folioscan.hotRows": "20",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate a column expression over one row of named values."""
    def run(build, **values):
        from pyspark.sql import functions as F
        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
        return row.select(build(*[F.col(k) for k in values]).alias("x")).first()["x"]

    return run


@pytest.fixture
def many(spark):
    """Evaluate a column expression over a list of texts."""
    def run(build, texts):
        from pyspark.sql import functions as F
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
        rows = df.select("i", build(F.col("t")).alias("x")).collect()
        return [r["x"] for r in sorted(rows, key=lambda r: r["i"])]

    return run
