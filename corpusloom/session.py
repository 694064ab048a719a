"""Session defaults and table access."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def ship_by_value() -> None:
    """Send this package's kernels to Python workers with their code, so that executors need no copy of it."""
    import corpusloom

    cloudpickle.register_pickle_by_value(corpusloom)


def local_session(app: str = "corpusloom", cpus: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the submitting side sets these."""
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    session = SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=settings).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of Parquet tables; any file system that Spark reads."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
