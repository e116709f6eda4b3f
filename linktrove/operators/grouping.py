"""Group helpers that stay safe when one key holds a large share of the rows."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linktrove.sources.scratch import materialize

PART_ROWS = 1000


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per key.

    A row_number window under a ``<= k`` filter: Spark cuts every key to k rows
    before the shuffle, so a hot key never travels whole.
    """
    name = rank or "_rank"
    w = Window.partitionBy(*keys).orderBy(*order)
    cut = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return cut if rank else cut.drop(name)


def ordered_parts(
    df: DataFrame, keys: list[str], index: str, value: Column, out: str, part_rows: int = PART_ROWS
) -> DataFrame:
    """Ordered list per key, cut into parts of ``part_rows`` rows.

    Rows are numbered densely by ``index`` (equal positions by value), so parts
    count from 0 without gaps and none is longer than ``part_rows``, however
    sparse or repeated the positions are.  A usual key has exactly one part; the
    parts of a huge one, read in order, give the whole list.
    """
    rows = df.select(*keys, F.col(index).alias("_i"), value.alias("_v"))
    numbered = stable_numbering(rows, keys, [F.col("_i"), F.col("_v")], F.floor(F.col("_i") / F.lit(10 * part_rows)), "_at")
    listed = numbered.groupBy(*keys, F.floor((F.col("_at") - 1) / F.lit(part_rows)).cast("int").alias("part")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("_at").alias("i"), F.col("_v").alias("v")))).alias("_rows")
    )
    return listed.withColumn(out, F.transform("_rows", lambda r: r["v"])).drop("_rows")


def stable_numbering(
    df: DataFrame, parent: list[str], order: list[Column], bucket: Column, name: str = "number"
) -> DataFrame:
    """Number rows 1..n per parent in order, without putting a parent in one task.

    ``bucket`` must grow with the order (for example the hour of an ordering
    timestamp, or ``floor(position / 10000)``).  Rows are numbered inside
    (parent, bucket); the sizes of a parent's earlier buckets are added.  A bucket
    is one task's work: where one may hold very many rows (say equal positions),
    use :func:`range_numbering`.
    """
    keyed = df.withColumn("_bucket", bucket)
    sizes = keyed.groupBy(*parent, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*parent).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(c).alias("_p_" + c) for c in parent],
        F.col("_bucket").alias("_p_bucket"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
    )
    inside = Window.partitionBy(*parent, "_bucket").orderBy(*order)
    numbered = keyed.withColumn("_inside", F.row_number().over(inside))
    same = reduce(
        lambda a, b: a & b,
        [F.col(c).eqNullSafe(F.col("_p_" + c)) for c in parent] + [F.col("_bucket").eqNullSafe(F.col("_p_bucket"))],
    )
    return (
        numbered.join(offsets, same, "left")
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop("_bucket", "_inside", "_offset", "_p_bucket", *["_p_" + c for c in parent])
    )


def range_numbering(
    df: DataFrame, parent: list[str], order: list[Column], name: str = "number", partitions: int | None = None
) -> DataFrame:
    """Number rows 1..n per parent in order; a parent of any shape is the work of many tasks.

    Rows are cut into ranges of about equal size by parent, order and their place
    in the input, so that even equal rows fall apart, and stored with the number
    of their range.  They are numbered inside (parent, range), and the sizes of a
    parent's earlier ranges are added.  Equal rows are numbered in any order.
    """
    tie, slot, size, inside, offset = "_tie", "_slot", "_size", "_inside", "_offset"
    placed = df.withColumn(tie, F.monotonically_increasing_id())
    keys = [*[F.col(c) for c in parent], *order, F.col(tie)]
    ranged = placed.repartitionByRange(partitions, *keys) if partitions else placed.repartitionByRange(*keys)
    stored = materialize(ranged.withColumn(slot, F.spark_partition_id()), "ranges")
    sizes = stored.groupBy(*parent, slot).agg(F.count(F.lit(1)).alias(size))
    before = Window.partitionBy(*parent).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = sizes.select(
        *[F.col(c).alias("_p_" + c) for c in parent], F.col(slot).alias("_p_slot"), F.coalesce(F.sum(size).over(before), F.lit(0)).alias(offset))
    numbered = stored.withColumn(inside, F.row_number().over(Window.partitionBy(*parent, slot).orderBy(*order, tie)))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col("_p_" + c)) for c in parent] + [F.col(slot) == F.col("_p_slot")])
    return numbered.join(offsets, same, "left").withColumn(name, F.col(inside) + F.col(offset)).select(*df.columns, name)
