"""Sessions and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "warraq", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that the engine is tested with; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A scan in no fewer partitions than there are cores: costly work on small tables isn't left to one task.

    Large tables have more partitions than cores and come back as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table of that name in a folder of tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
