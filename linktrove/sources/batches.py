"""Size of the Arrow batches between Spark and its Python workers."""

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch between Spark and its Python workers.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lets Spark hand out Arrow batches of ``BATCH_BYTES`` at most, unless the session names a smaller number of bytes."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.conf.get(name).rstrip("b")
    if not size.isdigit() or int(size) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")
