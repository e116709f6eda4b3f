"""Task source: paginated API responses to one row per task."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linktrove import schemas
from linktrove.functions.text import from_utc, iso_timestamp


def flatten_pages(raw: DataFrame, json_col: str = "raw", page_col: str = "page_no", item_ddl: str = schemas.RAW_TASK_DDL) -> DataFrame:
    """Flatten response pages into (page_no, item_no, item).

    A page may be an object with ``results``, a list (whose members may again
    be objects with ``results``, lists or items), or a single item.  Order is
    the page order, then the order inside the page.
    """
    def parse(text, ddl):
        return F.from_json(text, ddl)

    text = F.ltrim(F.col(json_col))
    # Everything becomes a list of members first; each member is then unpacked.
    members = F.when(text.startswith("["), parse(text, "ARRAY<STRING>")).otherwise(F.array(text))

    def unpack(member):
        member_text = F.ltrim(member)
        results = F.get_json_object(member_text, "$.results")
        return (
            F.when(member_text.startswith("["), parse(member_text, f"ARRAY<{item_ddl}>"))
            .when(results.isNotNull(), parse(results, f"ARRAY<{item_ddl}>"))
            .otherwise(F.array(parse(member_text, item_ddl)))
        )

    items = F.flatten(F.transform(F.coalesce(members, F.array().cast("array<string>")), unpack))
    return raw.select(F.col(page_col).alias("page_no"), F.posexplode(items).alias("item_no", "item"))


def read_task_pages(raw: DataFrame, json_col: str = "raw", page_col: str = "page_no") -> DataFrame:
    """Response pages -> ``tasks`` with typed columns."""
    flat = flatten_pages(raw, json_col, page_col)
    position = F.col("page_no") * F.lit(1 << 32) + F.col("item_no")
    return flat.select(
        F.col("item.id").try_cast("bigint").alias("id"),
        F.col("item.project_id").try_cast("bigint").alias("project_id"),
        F.col("item.content").alias("content"),
        F.col("item.description").alias("description"),
        F.coalesce("item.labels", F.array().cast("array<string>")).alias("labels"),
        from_utc(iso_timestamp(F.col("item.created_at"))).alias("created_at"),
        position.alias("input_pos"),
    )


def concat_all(*frames: DataFrame) -> DataFrame:
    """Plain concatenation; missing columns become NULL."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first
