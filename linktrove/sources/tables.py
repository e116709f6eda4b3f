"""Table reads."""

from pyspark.sql import DataFrame, SparkSession

#: Session setting of the caller: partitions that read tables are dealt to; unset, the file splits are kept.
PARTITIONS = "linktrove.read.partitions"


def read_table(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Parquet table, read the same way at every size.

    ``partitions``: deal the rows to so many partitions.  For tables of a few
    large row groups, which are few splits, under work that is dear per row;
    tables of many splits need none, as this moves every row.
    """
    partitions = partitions or int(spark.conf.get(PARTITIONS, "0"))
    table = spark.read.parquet(path)
    return table.repartition(partitions) if partitions else table
