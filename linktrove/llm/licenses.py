"""Operator 4: license scans by canonical digests, in DataFrame expressions only.

A text is reduced to what licences are compared by: lower case, copyright lines
gone, punctuation and spacing made single spaces, equivalent spellings made one.
The digest of the whole text, and of each of its lines, is looked up among the
digests of known licence texts and notices.

The known texts are a fixed list, so their digests are broadcast.

Defined results: NULL text counts as empty; a text or line that reduces to
nothing matches no licence.  Repeated rows are scanned alike; NULL ids are
kept; extra columns are not read.  A text may match one licence, its lines several.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linktrove.llm.license_texts import KNOWN

#: Spellings that license comparison treats as equal (after lower-casing).
SPELLINGS = [("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"),
             ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"), ("per cent", "percent"),
             ("copyright owner", "copyright holder"), ("organisation", "organization"), ("favour", "favor"),
             ("fulfilment", "fulfillment"), ("whilst", "while"), ("https:", "http:")]
COPYRIGHT_LINE = r"(^|\n)[^\p{L}\p{N}\n©]*(copyright[ \t]*(\(c\)|©|[0-9])|\(c\)[ \t]|©|all rights reserved)[^\n]*"
APART = r"[^\p{L}\p{N}]+"


def spaced(spelling: str) -> str:
    """A spelling as it stands once punctuation and spacing are single spaces."""
    return " ".join(w for w in re.split(r"[^a-z0-9]+", spelling) if w)


def canonical(text: Column) -> Column:
    """Spacing first: a spelling of two words may be broken over lines."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "\n")
    out = F.regexp_replace(out, APART, " ")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(spaced(old)), F.lit(spaced(new)))
    return F.trim(out)


def known_digests(spark) -> DataFrame:
    """(digest, license) of the known texts."""
    texts = spark.createDataFrame([(name, text) for name, text in KNOWN], "license string, text string")
    return texts.select(F.md5(canonical(F.col("text"))).alias("digest"), "license").dropDuplicates(["digest"])


def scan(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, digest, license of the whole text, license_lines (names, sorted, with commas)."""
    known = known_digests(docs.sparkSession)
    by_digest = known.select(F.map_from_entries(F.collect_list(F.struct("digest", "license"))).alias("names"))
    whole = docs.select(F.col(id).alias("doc_id"), F.md5(canonical(F.col(text))).alias("digest"),
                        F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.md5(canonical(x))).alias("lines"))
    # the fixed list: one row
    names = by_digest.first()["names"]
    lookup = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])
    lines = F.array_sort(F.array_distinct(F.array_compact(F.transform("lines", lambda d: lookup[d]))))
    return whole.join(F.broadcast(known), "digest", "left").select(
        "doc_id", "digest", "license", F.array_join(lines, ",").alias("license_lines"))
