"""Report sections and report rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linktrove import fixed_values as V
from linktrove.functions import text as T
from linktrove.operators.grouping import PART_ROWS, ordered_parts
from linktrove.operators.outcomes import extract_failed, fails_task


def report_filter(results: DataFrame, attempts: str = "processed_urls") -> DataFrame:
    """Tasks with at least one attempt, no extraction error and no model error."""
    bad = F.exists(attempts, lambda a: extract_failed(a["content"]) | fails_task(a["content"], a["error"]))
    return results.where(F.coalesce((F.size(attempts) > 0) & ~bad, F.lit(False)))


def reportable_tasks(attempts: DataFrame) -> DataFrame:
    """The same rule on attempt rows: task ids, by counting."""
    bad = extract_failed(F.col("content")) | fails_task(F.col("content"), F.col("error"))
    return attempts.groupBy("task_id").agg(F.count_if(bad).alias("n_bad")).where("n_bad = 0").select("task_id")


def media_links(s3_url: Column, video_path: Column, markdown_path: Column) -> Column:
    """Artifact links of one attempt."""
    s3, low = F.coalesce(s3_url, F.lit("")), F.lower(F.coalesce(s3_url, F.lit("")))

    def link(word: str, target: Column) -> Column:
        return F.concat(F.lit(f"- [{word}]("), target, F.lit(")"))

    is_video = low.contains("mp4")
    local = F.coalesce(video_path, F.lit("")) != ""
    video = F.when(is_video, link("Video: 1", s3)).when(local, link("Video: 1 (Local)", video_path))
    markdown = F.when(F.coalesce(markdown_path, F.lit("")) != "", link("Markdown", markdown_path))
    other = F.when(
        (s3 != "") & ~is_video,
        F.when(low.rlike(r"\.(jpg|jpeg|png)"), link("Image", s3))
        .when(low.contains(".mp3"), link("Audio", s3))
        .otherwise(link("Media", s3)),
    )
    return F.filter(F.array(video, markdown, other), lambda x: x.isNotNull())


def attempt_section(a: dict[str, Column]) -> Column:
    """Markdown of one attempt."""
    content = T.label_bare_links(T.number_media(F.coalesce(a["content"], F.lit(V.NO_ATTEMPT_CONTENT))))
    none = F.array().cast("array<string>")
    method = F.coalesce(a["extraction_method"], F.lit(""))
    links = media_links(a["s3_url"], a["downloaded_video_path"], a["downloaded_markdown_path"])
    s3 = F.coalesce(a["s3_url"], F.lit(""))
    shown = (F.size(links) > 0) & ((s3 == "") | ~content.contains(s3))
    error = F.coalesce(a["error"], F.lit(""))
    return F.array_join(
        F.concat(
            F.array(F.concat(F.lit("**Type**: "), T.capitalize(F.coalesce(a["type"], F.lit("unknown"))), F.lit("  "))),
            F.when(method != "", F.array(F.concat(F.lit("*Extraction Method: "), method, F.lit("*  ")), F.lit("  "))).otherwise(none),
            F.when(shown, F.concat(links, F.array(F.lit("")))).otherwise(none),
            F.when(error != "", F.array(F.concat(F.lit("**Error:** "), error))).otherwise(none),
            F.array(content, F.lit("")),
        ),
        "\n",
    )


def saved_note(content: Column, markdown_path: Column, pdf_path: Column) -> Column:
    """Content with a closing line about where its copy was saved."""
    note = F.coalesce(
        F.concat(F.lit("\n\n[Markdown version saved to: "), markdown_path, F.lit("]")),
        F.concat(F.lit("\n\n[PDF file saved to: "), pdf_path, F.lit("]")),
        F.lit(""),
    )
    return F.concat(content, note)


def task_header(content: Column, description: Column, labels: Column) -> Column:
    none = F.array().cast("array<string>")
    description = F.coalesce(description, F.lit(""))
    labels = F.coalesce(labels, none)
    return F.array_join(
        F.concat(
            F.array(F.concat(F.lit("## "), F.coalesce(content, F.lit("Unknown Task"))), F.lit("")),
            F.when(description != "", F.array(F.lit("### Original Description"), T.blockquote(description), F.lit(""))).otherwise(none),
            F.when(F.size(labels) > 0, F.array(F.lit("### Labels"), T.code_labels(labels), F.lit(""))).otherwise(none),
        ),
        "\n",
    )


TASK_FOOTER = "---\n"


def task_report(tasks: DataFrame, attempts: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """One markdown section per reportable task: (task_id, part, markdown).

    Attempts are listed by position.  A task of more than ``part_rows``
    attempts is cut into ordered parts; the header opens part 0 and the rule
    closes the last part, so the parts joined by newline are the section.
    ``tasks``: id, content, description, labels.
    """
    columns = {c: F.col(c) for c in (
        "type", "content", "error", "extraction_method", "s3_url", "downloaded_video_path", "downloaded_markdown_path"
    )}
    sections = attempts.select("task_id", "pos", attempt_section(columns).alias("section"))
    parts = ordered_parts(sections, ["task_id"], "pos", F.col("section"), "sections", part_rows)
    bad = extract_failed(F.col("content")) | fails_task(F.col("content"), F.col("error"))
    bounds = attempts.groupBy("task_id").agg(
        F.floor((F.count(F.lit(1)) - 1) / F.lit(part_rows)).cast("int").alias("last_part"),
        F.count_if(bad).alias("n_bad"),
    ).where("n_bad = 0").drop("n_bad")
    heads = tasks.select(
        F.col("id").alias("task_id"), task_header(F.col("content"), F.col("description"), F.col("labels")).alias("head")
    )
    none = F.array().cast("array<string>")
    return parts.join(bounds, "task_id").join(heads, "task_id").select(
        "task_id", "part",
        F.array_join(
            F.concat(
                F.when(F.col("part") == 0, F.array("head")).otherwise(none),
                F.col("sections"),
                F.when(F.col("part") == F.col("last_part"), F.array(F.lit(TASK_FOOTER))).otherwise(none),
            ),
            "\n",
        ).alias("markdown"),
    )
