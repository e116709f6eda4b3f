"""Artifact and report sinks: week-partitioned folders on any Hadoop path."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linktrove import fixed_values as V
from linktrove.functions import text as T
from linktrove.functions.html import html_to_markdown
from linktrove.operators.grouping import PART_ROWS
from linktrove.operators.pages import PAGE_RULES, field
from linktrove.sources.scratch import materialize


def with_week(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Adds iso_year, iso_week and the folder label ``week_NN``."""
    t = F.col(ts)
    return (
        df.withColumn("iso_year", T.iso_year(t))
        .withColumn("iso_week", T.iso_week(t))
        .withColumn("folder", T.week_folder(t))
    )


def artifact_keys(df: DataFrame, ts: str = "ts", filename: str = "filename", bucket: str | None = None) -> DataFrame:
    """Adds the object key ``year/week_NN/filename`` and, with a bucket, its URL."""
    keyed = with_week(df, ts).withColumn("key", F.concat_ws("/", F.col("iso_year").cast("string"), "folder", filename))
    if bucket:
        keyed = keyed.withColumn("s3_url", F.concat(F.lit(f"https://{bucket}.s3.amazonaws.com/"), F.col("key")))
    return keyed


def write_artifacts(df: DataFrame, root: str, fmt: str = "parquet", ts: str = "ts", mode: str = "append") -> None:
    """Write rows partitioned by ISO year and week (weeks of two years never meet).

    Rows are rebalanced by week: AQE splits a busy week over many tasks and
    files and packs quiet weeks together.  As ``text`` every document stands in a
    folder of its own name, which a later run with that name replaces.
    """
    spread = with_week(df, ts).hint("rebalance", "iso_year", "iso_week")
    if fmt == "text":
        named = spread.select("iso_year", "iso_week", "filename", F.col("content").alias("value"))
        writer = named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("iso_year", "iso_week", "filename").text(root)
    else:
        spread.write.mode(mode).partitionBy("iso_year", "iso_week").format(fmt).save(root)


def artifact_collisions(manifest: DataFrame, key: str = "key") -> DataFrame:
    """Artifacts whose key is used more than once, with the number of uses."""
    counts = manifest.groupBy(key).agg(F.count(F.lit(1)).alias("n_same_key")).where("n_same_key > 1")
    return manifest.join(counts, key)


def write_report(task_md: DataFrame, path: str, run_date: str, title: str | None = None) -> None:
    """Report rows as text under ``run_date=``: the title, then tasks and parts in order.

    A run without tasks says so.  Range partitioning gives every task of the write
    a slice of the order, so the files read in name order are the report; nothing
    is collected.  The rows are stored first: sampling the ranges reads them twice.
    """
    stored = materialize(task_md.select("task_id", "part", "markdown"), "report")
    n = stored.agg(F.count(F.lit(1)).alias("n"))
    head = n.select(
        F.lit(0).alias("place"), F.lit(None).cast(stored.schema["task_id"].dataType).alias("task_id"),
        F.lit(0).cast(stored.schema["part"].dataType).alias("part"),
        F.concat(F.lit(title or V.REPORT_TITLE + run_date), F.lit("\n"), F.when(F.col("n") == 0, F.lit(V.EMPTY_REPORT)).otherwise("")).alias("markdown"),
    )
    rows = head.unionByName(stored.withColumn("place", F.lit(1)))
    ordered = rows.repartitionByRange("place", "task_id", "part").sortWithinPartitions("place", "task_id", "part")
    ordered.select(F.col("markdown").alias("value")).write.mode("overwrite").text(f"{path}/run_date={run_date}")


def read_report(spark: SparkSession, path: str, run_date: str) -> DataFrame:
    """(n, value): the lines of a written report, numbered over its files in name order."""
    files = spark.read.text(f"{path}/run_date={run_date}", wholetext=True).select(F.input_file_name().alias("file"), "value")
    # every row ends with a line end, so what follows the last one is no line
    lines = files.select("file", F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n", -1)).alias("pos", "value"))
    # one entry per file
    sizes = lines.groupBy("file").agg(F.count(F.lit(1)).alias("size")).agg(F.sort_array(F.collect_list(F.struct("file", "size"))).alias("all"))
    bases = sizes.select(F.explode(F.transform("all", lambda x, i: F.struct(
        x["file"].alias("file"), F.aggregate(F.slice("all", F.lit(1), i), F.lit(0).cast("long"), lambda a, y: a + y["size"]).alias("base")))).alias("f"))
    return lines.join(bases.select("f.file", "f.base"), "file").select((F.col("base") + F.col("pos") + 1).alias("n"), "value")


def reference_records(videos: DataFrame, processed_at: Column) -> DataFrame:
    """JSON record per video that points at the video instead of storing it."""
    record = F.struct(
        F.col("video_id").alias("youtube_video_id"),
        F.col("title"),
        F.concat(F.lit("https://www.youtube.com/watch?v="), "video_id").alias("url"),
        processed_at.cast("bigint").alias("processed_at"),
        F.lit("youtube_video").alias("reference_type"),
        F.concat(F.lit("https://www.youtube.com/embed/"), "video_id").alias("direct_embed_url"),
    )
    name = F.concat(processed_at.cast("string"), F.lit("_"), T.clean_title(F.col("title")), F.lit("_reference.json"))
    return videos.select("video_id", name.alias("filename"), F.to_json(record).alias("content"))


def transcript_docs(
    segments: DataFrame, videos: DataFrame, timestamp: Column, lang: str = "en", include_metadata: bool = True,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Transcript documents: optional metadata header in the first part, then the text parts.

    A transcript without a video row has no header and is named by its id.  The
    parts of a long transcript carry their number in the file name.
    """
    from linktrove.operators.video import transcript_text

    metadata = F.struct(
        "video_id", "title",
        F.concat(F.lit("https://www.youtube.com/watch?v="), "video_id").alias("url"),
        timestamp.cast("bigint").alias("timestamp"),
        F.col("published_at").alias("published_date"),
        "description",
        F.lit("en").alias("default_language"),
        F.lit(lang).alias("transcript_language"),
    )
    header = F.concat(
        F.lit("--- Video Metadata ---\n"), F.to_json(metadata, {"pretty": "true", "ignoreNullFields": "false"}),
        F.lit("\n\n--- Transcript ---\n\n"),
    )
    described = videos.select(
        "video_id", header.alias("header"), T.transcript_filename(timestamp.cast("bigint"), F.col("title")).alias("filename")
    )
    text = F.col("text")
    first = F.col("part") == 0
    content = F.when(first, F.concat(F.coalesce("header", F.lit("")), text)).otherwise(text) if include_metadata else text
    name = F.coalesce("filename", F.concat("video_id", F.lit(".txt")))
    numbered = F.regexp_replace(name, F.lit(r"\.txt$"), F.concat(F.lit("_part_"), (F.col("part") + 1).cast("string"), F.lit(".txt")))
    of_video = Window.partitionBy("video_id")  # one row per part
    parts = transcript_text(segments, part_rows).withColumn("_last", F.max("part").over(of_video))
    return parts.join(described, "video_id", "left").select(
        "video_id", "part", F.when(F.col("_last") == 0, name).otherwise(numbered).alias("filename"), content.alias("content")
    )


def page_markdown_docs(pages: DataFrame, captured: Column) -> DataFrame:
    """Markdown file per page: title, source, capture time, rule, body."""
    title = field(F.coalesce(F.col("html"), F.lit("")), PAGE_RULES[0])
    title = F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled Webpage"))
    doc = F.concat(
        F.lit("# "), title, F.lit("\n\nSource: ["), F.col("url"), F.lit("]("), F.col("url"), F.lit(")\n\nCaptured on: "),
        F.date_format(captured, "yyyy-MM-dd HH:mm:ss"), F.lit("\n\n---\n\n"), html_to_markdown(F.col("html")),
    )
    return pages.select("page_id", T.page_filename(F.col("url"), captured).alias("filename"), doc.alias("content"))
