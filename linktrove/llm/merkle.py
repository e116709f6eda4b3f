"""Operator 9: document fingerprints as Merkle trees over paragraphs and sections.

Leaves are up to three words of a sentence, their parents the lines of the text as
paragraphs, theirs sections: runs of paragraphs that end where a paragraph's
digest says so, so an edit moves no section end elsewhere.  The root is a digest
of the section digests, a section's of its paragraphs', a paragraph's of its leaves'.

A fingerprint is the whole tree as a string: the root, then per section its digest
and per paragraph its digest and its leaves, cut to ``LEAF_BYTES`` each.  Equal texts
have equal fingerprints, unequal roots tell texts apart.  Two trees are walked
from the root: branches of equal digest are settled without being opened, what is
left is compared one level down.  The likeness is the share of leaves in common,
and the paragraphs left over locate the edits.

Documents follow each other by descending id.  They are dealt into ranges of ids
and sorted there; each range also gets the first document of the range after it,
so every document meets its successor with one exchange of the texts.

Defined results: NULL text counts as empty; the fingerprint of no text has no
leaves, and two empty fingerprints are alike (1.0).  NULL ids come last; rows of
equal id follow each other by text.  A single row is its own next document.
Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECTION = 16
#: Bytes of a leaf and of a branch that a fingerprint keeps, in base 64; a branch takes 8 characters.
LEAF_BYTES, BRANCH_BYTES, BRANCH_CHARS = 4, 6, 8
#: Up to three words, fewer at the end of a sentence; the leaves of a line are all of it.
LEAF = re.compile(r"\s*(?:\S*[^\s.!?]\s+){0,2}\S+|\s+$")
NO_ID = -(1 << 63)


def letters(digest: bytes) -> str:
    return base64.urlsafe_b64encode(digest).decode().rstrip("=")


def fingerprint(text: str | None) -> str:
    """``root:`` and sections by ``/``: digest, ``=`` and paragraphs by ``;``, each its digest and its leaves."""
    if not text:
        return "0" * 32 + ":"
    sections, paragraphs, digests = [], [], []
    root = hashlib.blake2b(digest_size=16)

    def close() -> None:
        section = hashlib.blake2b(b"".join(digests), digest_size=16).digest()
        root.update(section)
        sections.append(letters(section[:BRANCH_BYTES]) + "=" + ";".join(paragraphs))

    for line in text.split("\n"):
        leaves = [xxhash.xxh3_64_digest(s) for s in LEAF.findall(line)]
        digest = xxhash.xxh3_64_digest(b"".join(leaves))
        paragraphs.append(letters(digest[:BRANCH_BYTES]) + letters(b"".join([x[:LEAF_BYTES] for x in leaves])))
        digests.append(digest)
        if digest[7] % 4 == 0 or len(digests) == SECTION:
            close()
            paragraphs, digests = [], []
    if digests:
        close()
    return root.hexdigest() + ":" + "/".join(sections)


def sections_of(print_: str) -> list[str]:
    return print_.partition(":")[2].split("/") if not print_.endswith(":") else []


def paragraphs_of(section: str) -> list[str]:
    return section[BRANCH_CHARS + 1:].split(";")


def leaves_of(paragraph: str) -> list[bytes]:
    body = paragraph[BRANCH_CHARS:]
    body = base64.urlsafe_b64decode(body + "=" * (-len(body) % 4))
    return [body[k:k + LEAF_BYTES] for k in range(0, len(body), LEAF_BYTES)]


def leaf_count(print_: str) -> int:
    return sum((len(p) - BRANCH_CHARS) * 3 // (4 * LEAF_BYTES) for s in sections_of(print_) for p in paragraphs_of(s))


def unmatched(mine: list[str], other: list[str]) -> tuple[list[int], list[int]]:
    """Places of the branches on either side that have no partner of equal digest on the other."""
    left = Counter([b[:BRANCH_CHARS] for b in other])
    open_mine = []
    for k, b in enumerate(mine):
        if left[b[:BRANCH_CHARS]] > 0:
            left[b[:BRANCH_CHARS]] -= 1
        else:
            open_mine.append(k)
    open_other = []
    for k in range(len(other) - 1, -1, -1):
        if left[other[k][:BRANCH_CHARS]] > 0:
            left[other[k][:BRANCH_CHARS]] -= 1
            open_other.append(k)
    return open_mine, open_other[::-1]


def walk(a: str, b: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(section, paragraph, branch) of the paragraphs of either tree that the other lacks."""
    if a.partition(":")[0] == b.partition(":")[0]:
        return [], []
    mine, other = sections_of(a), sections_of(b)
    left, right = unmatched(mine, other)
    below = [[(i, j, p) for i in places for j, p in enumerate(paragraphs_of(side[i]))] for side, places in ((mine, left), (other, right))]
    keep = unmatched(*([p for _, _, p in rows] for rows in below))
    return [below[0][k] for k in keep[0]], [below[1][k] for k in keep[1]]


def likeness(a: str, b: str) -> float:
    """Leaves in common, counted with repeats, as a share of the mean number of leaves."""
    if a == b:
        return 1.0
    x, y = (Counter(x for _, _, p in side for x in leaves_of(p)) for side in walk(a, b))
    apart = sum((x - y).values()) + sum((y - x).values())
    n = leaf_count(a) + leaf_count(b)
    return (n - apart) / n if n else 0.0


def differences(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) places of ``a`` that ``b`` does not have; equal branches are not entered."""
    return [(i, j) for i, j, _ in walk(a, b)[0]]


def fingerprints(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint) of every document; no exchange."""
    source = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([fingerprint(t) for t in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), prints], names=["doc_id", "fingerprint"])

    return source.mapInArrow(run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Rows (range, guest, doc_id, text), sorted so that the next row of a range is the next document."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(NO_ID)).alias("key"), F.col(id).cast("long").alias("doc_id"),
                        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # n - 1 bounds, and the greatest key of each of the n ranges
    bounds = sorted(set(keyed.approxQuantile("key", [k / n for k in range(1, n)], 0.1 / n))) if n > 1 else []
    cuts = np.array([int(b) for b in bounds], np.int64)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        greatest: dict[int, int] = {}
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for r in np.unique(place := np.searchsorted(cuts, keys)):
                greatest[int(r)] = max(greatest.get(int(r), NO_ID), int(keys[place == r].max()))
        yield pa.RecordBatch.from_arrays([pa.array(list(greatest), pa.int32()), pa.array(list(greatest.values()), pa.int64())], names=["range", "key"])

    tops = sorted((r["range"], r["key"]) for r in keyed.select("key").mapInArrow(ranges, "range int, key long")
                  .groupBy("range").agg(F.max("key").alias("key")).collect())
    # the first document of a range is also needed by the range before it in descending order
    host = {key: tops[(k + 1) % len(tops)][0] for k, (_, key) in enumerate(tops)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            own = pa.array(np.searchsorted(cuts, keys), pa.int32())
            no = pa.array(np.zeros(len(keys), bool))
            names = ["range", "guest", "key", "doc_id", "text"]
            yield pa.RecordBatch.from_arrays([own, no, *batch.columns], names=names)
            guests = np.flatnonzero(np.isin(keys, list(host)))
            if len(guests):
                part = batch.take(pa.array(guests))
                yield pa.RecordBatch.from_arrays([pa.array([host[k] for k in part.column(0).to_pylist()], pa.int32()),
                                                  pa.array(np.ones(len(guests), bool)), *part.columns], names=names)

    dealt = keyed.mapInArrow(deal, "range int, guest boolean, key long, doc_id long, text string")
    return dealt.repartition(n, "range").sortWithinPartitions("range", "guest", F.desc("key"), "text")


def edited_prints(docs: DataFrame, text: str = "text", id: str = "doc_id", share: int = 3) -> DataFrame:
    """Each document against its edited text (the last 1/``share`` from the next document) and the next."""
    def row(doc_id: int | None, t: str, own: str, nxt: str, nxt_print: str) -> tuple:
        k = len(t) // share
        edited = t[:len(t) - k] + nxt[:k]
        changed = fingerprint(edited)
        return (doc_id, len(t), hashlib.sha256(edited.encode()).hexdigest(), own, changed, likeness(own, changed), likeness(own, nxt_print))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (range, doc_id, text, fingerprint) of the row whose next is awaited
        for batch in batches:
            out = []
            for r, guest, doc_id, t in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4))):
                own = fingerprint(t) if not guest or held is not None and held[0] == r else ""
                if held is not None and held[0] == r:
                    out.append(row(*held[1:], t, own))
                held = None if guest else (r, doc_id, t, own)
            columns = list(zip(*out)) or [[]] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in schema.split(", ")])

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, text, id).mapInArrow(run, schema)
