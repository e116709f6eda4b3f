"""Session with the settings the jobs are designed for (all may be overridden)."""

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: str = "*", **extra: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("linktrove")
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": "8" if cpus == "*" else cpus,
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
