"""Operator 13: line dedup over documents, in DataFrame functions only.

Every line is reduced to a key (blanks stripped at both ends, A-Z in lower case).
128-bit hashes of the keys that are long enough are range-partitioned with document
(largest first) and position behind them, and stored as sorted runs.  Because the
ranges are cut by all three columns, a line that a third of all documents hold lies
in many ranges; each range reduces it to one partial row.  Keys of enough documents
lose their lines outside the largest document, and what is returned per document is
a compressed keep bitmap: the runs of lines that stay.  Texts travel only when
``kept_text`` applies a bitmap.

Defined results: NULL and empty texts are one empty line.  Rows of one doc_id count
as one document, yet each row has its own bitmap (rows are told apart by the digest
of their text, so equal rows share one).  NULL ids are one document, smaller than all
others.  Blanks are U+0020 and U+0009 to U+000D; lengths are code points.  Extra
columns are not read, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linktrove.sources.scratch import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
LEAST_CHARS = 40
LEAST_DOCS = 5
#: A key is hot when it holds at least one in so many of all long lines; so there are no more hot keys than that.
HOT = 1000
RUNS = "array<struct<start:int,n:int>>"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _rows(docs: DataFrame, text: str, id: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id).alias("doc_id"), whole.alias("text"), F.unhex(F.md5(whole)).alias("digest"))


def sorted_lines(rows: DataFrame, least_chars: int) -> DataFrame:
    """(hash, doc_id, digest, pos) of long lines as stored runs: by hash, largest document, position."""
    lines = rows.select("doc_id", "digest", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc_id", "digest", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= least_chars)
    hashed = keyed.select(F.unhex(F.md5("key")).alias("hash"), "doc_id", "digest", "pos")
    order = [F.col("hash"), F.col("doc_id").desc_nulls_last(), F.col("pos")]
    return materialize(hashed.repartitionByRange(*order).sortWithinPartitions(*order), "lines")


def line_bitmaps(docs: DataFrame, text: str = "text", id: str = "doc_id",
                 least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, digest, dropped, keep) of the rows that lose lines: number lost and runs of lines that stay.

    ``keep`` is open at its end: the last run has n = NULL and reaches the last line.
    """
    lines = sorted_lines(_rows(docs, text, id), least_chars)
    # first occurrences of a key in a document, then one row per key: both combine before they shuffle
    seen = lines.groupBy("hash", "doc_id").agg(F.lit(1).alias("one")).groupBy("hash").agg(
        F.count("one").alias("docs"), F.max("doc_id").alias("keeper"))
    common = materialize(seen.where(F.col("docs") >= least_docs), "common")
    # keys with more than their share of the lines meet them by broadcast (no more than HOT can be such), the others by hash
    is_hot = F.col("docs") * HOT >= lines.count()
    hot = F.broadcast(common.where(is_hot).select("hash", "keeper"))
    met = [lines.join(hot, "hash"), lines.join(hot, "hash", "left_anti").join(common.where(~is_hot).select("hash", "keeper"), "hash")]
    lost = met[0].unionByName(met[1]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    listed = lost.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set("pos")).alias("lost"))
    starts = F.concat(F.array(F.lit(0)), F.transform("lost", lambda p: p + 1))
    ends = F.concat(F.col("lost"), F.array(F.lit(None).cast("int")))
    runs = F.filter(F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e - s).alias("n"))),
                    lambda r: F.coalesce(r["n"] > 0, F.lit(True)))
    return listed.select("doc_id", "digest", F.size("lost").alias("dropped"), runs.cast(RUNS).alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """The lines of the runs, joined; NULL runs keep everything."""
    lines = F.split(text, "\n", -1)
    parts = F.transform(keep, lambda r: F.slice(lines, r["start"] + 1, F.greatest(F.coalesce(r["n"], F.size(lines) - r["start"]), F.lit(0))))
    return F.when(keep.isNull(), text).otherwise(F.array_join(F.flatten(parts), "\n"))


def with_bitmaps(docs: DataFrame, text: str = "text", id: str = "doc_id", **limits: int) -> DataFrame:
    """(doc_id, text, dropped, keep) of every row; the join meets documents by id and digest."""
    rows = _rows(docs, text, id)
    maps = line_bitmaps(docs, text, id, **limits).withColumnRenamed("doc_id", "map_id").withColumnRenamed("digest", "map_digest")
    same = F.col("doc_id").eqNullSafe(F.col("map_id")) & (F.col("digest") == F.col("map_digest"))
    return rows.join(maps, same, "left").select("doc_id", "text", F.coalesce("dropped", F.lit(0)).alias("dropped"), "keep")


def dedup_lines(docs: DataFrame, text: str = "text", id: str = "doc_id", **limits: int) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row."""
    return with_bitmaps(docs, text, id, **limits).select(
        "doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), F.col("dropped").cast("long").alias("n_dropped"),
        F.sha2(kept_text(F.col("text"), F.col("keep")).cast("binary"), 256).alias("kept_sha256"))
