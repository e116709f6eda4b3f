"""Operator 6: near duplicates by DartMinHash over weighted five-word shingles.

A text is a multiset of shingles; a shingle's weight is how often it occurs.
Darts fall on every (shingle, weight, rank) plane as a Poisson process drawn from
the shingle's hash, so all documents see the same darts.  A document takes those
below its weights and below a rank limit inverse to its total weight, which is
about ``K`` ln ``K`` darts for any length; each dart names a coordinate, and the
darts of least rank are the signature.  Two signatures agree in a coordinate
with the weighted Jaccard similarity as probability.

``BANDS`` bands of ``ROWS`` coordinates propose partners.  Equal texts are one
node before that.  In a bucket every node is compared with ``CENTRES`` leaders, not
with all others: the nodes that share most places in buckets, as the common source
of a group of copies does.  Links are checked exactly on the shingles; nodes of a
bucket that stay in different groups meet new leaders, one per group and ``LEADERS``
per bucket, in further rounds, until a round finds no link.  Work is linear in a bucket's size in each round.
A pair at similarity 0.8 misses all buckets with a probability of 2e-4.

Defined results: words are split at white space and lower-cased; a text of
fewer than five words is one shingle.  NULL and wordless texts are equal texts
without partners among others.  ``class_id`` is the least doc_id of a group (NULL
where no member has one); repeated rows are members of one class.  Extra columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linktrove.llm.batches import slices, unused
from linktrove.llm.vocab import Recent
from linktrove.operators.grouping import first_per_key
from linktrove.sources.scratch import materialize

BANDS, ROWS = 28, 6
K = BANDS * ROWS
SHINGLE, SIMILARITY = 5, 0.8
CENTRES = 3  # leaders of a bucket
PREFIX = 8  # bytes before the text key in a node's name
DARTS = K * (np.log(K) + 2)  # darts expected below the rank limit
CELLS = 1 << 19  # dart cells worked on at a time

with np.errstate(over="ignore"):
    ODD = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(SHINGLE)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (a multiply-xorshift finaliser)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


#: Poisson(1): chance of at most 0, 1, 2, ... darts in a cell of area one.
AT_MOST = np.cumsum(np.exp(-1.0) / np.cumprod(np.r_[1.0, np.arange(1, 16)]))


def throw(shingles: np.ndarray, weights: np.ndarray, owner: np.ndarray, limit: np.ndarray, n: int) -> np.ndarray:
    """Signatures (n x K, 0 where no dart fell) of n documents.

    ``owner`` is each shingle's document, ``limit`` each document's rank limit.
    Weight is cut at 1, 2, 4, ...: a strip is ``wide`` units, its cells are
    ``1 / wide`` ranks high.
    """
    with np.errstate(over="ignore"):
        top = np.floor(np.log2(weights)).astype(np.int64) + 1  # strips that begin below the weight
        top -= (weights == 2.0 ** (top - 1)) & (weights > 1)
        e = np.repeat(np.arange(len(shingles)), top)
        strip = np.arange(len(e)) - np.repeat(np.cumsum(top) - top, top)
        low = np.where(strip == 0, 0.0, 2.0 ** (strip - 1))
        wide = np.where(strip == 0, 1.0, low)
        cells = np.ceil(limit[owner[e]] * wide).astype(np.int64)
        s = np.repeat(np.arange(len(e)), cells)
        cell = np.arange(len(s)) - np.repeat(np.cumsum(cells) - cells, cells)
        key = mix(shingles[e[s]] + mix(strip[s].astype(np.uint64) * ODD[0] + cell.astype(np.uint64) * ODD[1] + ODD[2]))
        darts = np.searchsorted(AT_MOST, unit(key))
        d = np.repeat(np.arange(len(s)), darts)
        which = np.arange(len(d)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mix(key[d] + (which.astype(np.uint64) + np.uint64(1)) * ODD[3])
        piece = s[d]
        rank = (cell[d] + unit(mix(dart + ODD[1]))) / wide[piece]
        weight = low[piece] + wide[piece] * unit(mix(dart + ODD[2]))
        doc = owner[e[piece]]
        hit = (rank < limit[doc]) & (weight < weights[e[piece]])
        dart, rank = dart[hit], rank[hit]
        slot = doc[hit] * K + (mix(dart + ODD[4]) % np.uint64(K)).astype(np.int64)
        order = np.argsort(-rank, kind="stable")
        out = np.zeros(n * K, np.uint64)
        out[slot[order]] = dart[order]  # the earliest dart is written last
        return out.reshape(n, K)


def signatures(docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Signatures of (shingles, weights) multisets; none may be empty."""
    out = np.zeros((len(docs), K), np.uint64)
    total = np.array([w.sum() for _, w in docs], np.float64)
    limit = DARTS / total if len(docs) else total
    todo = np.arange(len(docs))
    while len(todo):
        sizes = np.maximum([len(docs[k][0]) for k in todo], limit[todo] * total[todo])
        for part in np.split(todo, np.flatnonzero(np.diff(np.cumsum(sizes) // CELLS)) + 1):
            owner = np.repeat(np.arange(len(part)), [len(docs[k][0]) for k in part])
            out[part] = throw(np.concatenate([docs[k][0] for k in part]), np.concatenate([docs[k][1] for k in part]).astype(np.float64),
                              owner, limit[part], len(part))
        todo = todo[(out[todo] == 0).any(axis=1)]
        limit[todo] *= 2  # a coordinate got no dart: look further
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band and document."""
    with np.errstate(over="ignore"):
        parts = signature.reshape(len(signature), BANDS, ROWS)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * ODD[0], parts.shape[:2])
        for r in range(ROWS):
            key = mix(key * ODD[1] + parts[:, :, r])
        return key


class Shingles:
    """Hashed five-word shingles of whole texts with their weights."""

    def __init__(self) -> None:
        self.hashes = Recent(xxhash.xxh3_64_intdigest, limit=200_000)

    def words(self, text: str | None) -> list[str]:
        return (text or "").lower().split()

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        with np.errstate(over="ignore"):
            if len(h) < SHINGLE:
                h = mix((h * ODD[:len(h)]).sum(keepdims=True) + np.uint64(len(h)))
            else:
                n = len(h) - SHINGLE + 1
                h = mix(sum((h[k:k + n] * ODD[k] for k in range(1, SHINGLE)), h[:n] * ODD[0]))
        return np.unique(h, return_counts=True)


def text_key(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest()


def sign(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, key of the words, shingle count, band keys) per document; no shuffle."""
    source = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            for rows in slices(batch, 1):
                part = [shingles.words(t) for t in rows.column(1).to_pylist()]
                sets = {k: shingles(w) for k, w in enumerate(part) if w}
                keys = band_keys(signatures(list(sets.values()))).view(np.int64)
                bands = [[]] * len(part)
                for row, k in enumerate(sets):
                    bands[k] = keys[row]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([text_key(w) for w in part], pa.binary()),
                     pa.array([max(0, len(w) - SHINGLE + 1) or min(1, len(w)) for w in part], pa.int64()),
                     pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "key", "n", "bands"])

    return source.mapInArrow(run, "doc_id long, key binary, n long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, text: str, id: str) -> DataFrame:
    """(key, shingles, weights) of the wanted texts (rows: doc_id of one holder, key: name of the node)."""
    source = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    held = source.join(wanted.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")),
                       F.col("doc_id").eqNullSafe(F.col("_id"))).select("_key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for rows in (part for batch in batches for part in slices(batch, 1)):
            keys, hashes, weights = [], [], []
            for key, t in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                words = shingles.words(t)
                if text_key(words) == key[PREFIX:]:  # another row may share the doc_id
                    h, w = shingles(words)
                    keys.append(key)
                    hashes.append(h.astype("<u8").tobytes())
                    weights.append(w.astype("<u4").tobytes() if w.max(initial=1) > 1 else b"")
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.binary()), pa.array(weights, pa.binary())],
                                             names=["key", "shingles", "weights"])

    return held.mapInArrow(run, "key binary, shingles binary, weights binary").dropDuplicates(["key"])


def similarity(a: tuple[bytes, bytes], b: tuple[bytes, bytes]) -> float:
    """Weighted Jaccard similarity of two (shingles, weights)."""
    x, y = np.frombuffer(a[0], "<u8"), np.frombuffer(b[0], "<u8")
    v = np.frombuffer(a[1], "<u4").astype(np.int64) if a[1] else np.ones(len(x), np.int64)
    w = np.frombuffer(b[1], "<u4").astype(np.int64) if b[1] else np.ones(len(y), np.int64)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = int(np.minimum(v[i], w[j]).sum())
    return common / (int(v.sum()) + int(w.sum()) - common)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the limit."""
    left = sets.select(F.col("key").alias("a"), F.struct("shingles", "weights").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.struct("shingles", "weights").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            same = []
            for p, q in zip(x, y):  # one pair's shingles at a time
                p, q = p.as_py(), q.as_py()
                same.append(similarity((p["shingles"], p["weights"]), (q["shingles"], q["weights"])) >= SIMILARITY)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(same, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(run, "a binary, b binary")


def prefix_pairs(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a > b) of different roots among nodes (key, root) that may reach the limit; all that do are among them.

    The k-th occurrence of a shingle is an element of its own, so that weights are
    plain sets.  Elements are ordered by the number of nodes that hold them.
    """
    spark = nodes.sparkSession

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, root, shingles, weights in zip(*(batch.column(k) for k in range(4))):
                x = np.frombuffer(shingles.as_buffer(), "<u8")
                if len(weights.as_buffer()):
                    w = np.frombuffer(weights.as_buffer(), "<u4").astype(np.int64)
                    turn = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
                    with np.errstate(over="ignore"):
                        x = np.repeat(x, w)
                        x = np.where(turn > 0, mix(x + turn.astype(np.uint64) * ODD[1]), x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key.as_py()], pa.binary()), pa.array([root.as_py()], pa.binary()), pa.array([len(x)], pa.int64()),
                     pa.array([x.view(np.int64)], pa.list_(pa.int64()))], names=["key", "root", "n", "elements"])

    listed = nodes.join(sets, "key").select("key", "root", "shingles", "weights").mapInArrow(
        elements, "key binary, root binary, n long, elements array<long>")
    held = materialize(listed.select("key", "root", "n", F.explode("elements").alias("e")), "elements", spark)
    # elements of one root cannot link roots; they stand first, as a node's own ones do
    used = held.groupBy("e", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("e").agg(
        F.sum("c").alias("df"), F.count(F.lit(1)).alias("roots"), F.max_by("root", "c").alias("top")).where("roots > 1")
    shared = held.join(used.select("e", "df", "top"), "e").withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("key")))
    # a window over one text's elements
    place = F.col("n") - F.col("many") + F.row_number().over(Window.partitionBy("key").orderBy("df", "e")) - 1
    t = SIMILARITY
    # a little below the limit, so that rounding loses nothing
    probe = F.col("n") - F.ceil(F.col("n") * (t - 1e-9))
    index = F.col("n") - F.ceil(F.col("n") * (2 * t / (1 + t) - 1e-9))
    first = materialize(shared.withColumn("p", place).where(F.col("p") <= probe).select(
        "key", "root", "n", "e", "p", (F.col("p") <= index).alias("index"), (F.col("root") == F.col("top")).alias("is_top")), "prefixes", spark)
    x = first.where("index").select("e", *[F.col(c).alias("x_" + c) for c in ("key", "root", "n", "p", "is_top")])
    y = first.select("e", *[F.col(c).alias("y_" + c) for c in ("key", "root", "n", "p", "is_top")])
    room = F.least(F.col("x_n") - F.col("x_p"), F.col("y_n") - F.col("y_p"))
    fits = (
        (F.col("x_root") != F.col("y_root")) & (F.struct("x_n", "x_key") < F.struct("y_n", "y_key"))
        & (F.col("x_n") >= F.col("y_n") * (t - 1e-9)) & (room >= (F.col("x_n") + F.col("y_n")) * (t / (1 + t) - 1e-9))
    )
    # nodes of different roots are not both of the element's largest root
    met = x.where("NOT x_is_top").join(y, "e").where(fits).unionByName(x.where("x_is_top").join(y.where("NOT y_is_top"), "e").where(fits))
    return materialize(met.select(F.greatest("x_key", "y_key").alias("a"), F.least("x_key", "y_key").alias("b")).distinct(), "near-pairs", spark)


def components(links: DataFrame) -> DataFrame:
    """(key, root) of every node in the links (a, b), by alternating stars.

    Each pass hangs a node's neighbours under its least one; passes go on until
    nothing changes, a number that grows with the logarithm of the longest path.
    """
    spark = links.sparkSession
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links", spark)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # stored, so that the join below can split the neighbours of one node
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")), "least", spark)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))  # few per node: its neighbours are least ones by now
        small = (large.join(small_min, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(small_min.select("u", F.col("m").alias("v"))).distinct())
        edges = materialize(small, "stars", spark)
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            edges.select("v", F.lit(0), F.lit(1)).distinct())
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty():
            break
    roots = edges.select(F.col("u").alias("key"), F.col("v").alias("root"))
    return roots.union(roots.select("root", "root").distinct())


def classes(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, key, class_id, n_class) of every document; rows of one class are near duplicates."""
    spark = docs.sparkSession
    signed = materialize(sign(docs, text, id), "signatures", spark)
    nodes = signed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    member = nodes.select("key", "doc_id", "n", F.posexplode("bands").alias("band", "value"))
    full = materialize(member.groupBy("band", "value").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "full-buckets", spark)
    # a node's name begins with its places in buckets, so that the most central nodes come first;
    # a node has BANDS rows at most in the window
    places = F.sum("size").over(Window.partitionBy("key"))
    named = F.concat(F.unhex(F.lpad(F.hex(F.lit(1 << 62) - places), 2 * PREFIX, "0")), "key")
    member = materialize(member.join(full, ["band", "value"]).withColumn("key", named), "buckets", spark)
    sets = materialize(_sets(docs, member.select("doc_id", "key").distinct(), text, id), "shingle-sets", spark)

    # the leaders of a bucket are its nodes of least name, under which components hangs their groups
    heads = member.select("band", "value", F.struct("key", "n").alias("head"))
    leaders = materialize(first_per_key(heads, ["band", "value"], [F.col("head")], CENTRES).select(
        "band", "value", F.col("head").alias("leader")), "leaders", spark)
    met = heads.join(leaders, ["band", "value"]).where(F.col("head.key") != F.col("leader.key")).where(
        F.least("head.n", "leader.n") >= SIMILARITY * F.greatest("head.n", "leader.n"))
    pairs = met.select(F.greatest("head.key", "leader.key").alias("a"), F.least("head.key", "leader.key").alias("b")).distinct()
    tested = materialize(pairs, "pairs", spark)
    roots = materialize(components(materialize(_verified(tested, sets), "verified", spark)), "components", spark)

    # smaller buckets were compared in full
    wide = member.where(F.col("size") > CENTRES + 1).join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    mixed = wide.groupBy("band", "value").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    left = materialize(wide.join(mixed, ["band", "value"], "left_semi").select("key", "root").distinct(), "left", spark)
    if not left.isEmpty():
        late = materialize(_verified(prefix_pairs(left, sets).join(tested, ["a", "b"], "left_anti"), sets), "verified", spark)

        def rooted(side: str) -> DataFrame:
            return roots.select(F.col("key").alias(side), F.col("root").alias(f"{side}_root"))

        between = late.join(rooted("a"), "a", "left").join(rooted("b"), "b", "left").select(
            F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
        over = components(between).select(F.col("key").alias("_old"), F.col("root").alias("_new"))
        known = roots.union(over.select("_old", "_old")).distinct()
        roots = materialize(known.join(over, F.col("root") == F.col("_old"), "left").select(
            "key", F.coalesce("_new", "root").alias("root")), "components", spark)

    plain = nodes.select("key", "doc_id")
    roots = roots.select(F.substring("key", PREFIX + 1, 16).alias("key"), "root")
    grouped = plain.join(roots, "key", "left").select("key", "doc_id", F.coalesce("root", "key").alias("root"))
    grouped = materialize(grouped, "grouped", spark)
    least = materialize(grouped.groupBy("root").agg(F.min("doc_id").alias("class_id")), "least-ids", spark)
    named = materialize(grouped.join(least, "root").select("key", "root", "class_id"), "named", spark)
    return signed.select("doc_id", "key").join(named, "key")


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id and class_id of every document."""
    return classes(docs, text, id).select("doc_id", "class_id")


def keep_one(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row of each class, with all columns: the first by doc_id, NULL last, then by words."""
    found = classes(docs, text, id)
    words_of, kept_id, kept_key, turn = unused(docs.columns, "words", "id", "key", "turn")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("f"))
    keep = materialize(first.select(F.col("f.doc_id").alias(kept_id), F.col("f.key").alias(kept_key)), "kept", docs.sparkSession)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for rows in (part for batch in batches for part in slices(batch, place)):
            keys = pa.array([text_key(shingles.words(t)) for t in rows.column(place).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*rows.columns, keys], names=[*rows.schema.names, words_of])

    keyed = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(words_of, T.BinaryType())]))
    kept = keyed.join(keep, F.col(id).cast("long").eqNullSafe(F.col(kept_id)) & (F.col(words_of) == F.col(kept_key)))
    once = Window.partitionBy(kept_id, words_of).orderBy(F.lit(1))  # equal rows: any of them
    return kept.withColumn(turn, F.row_number().over(once)).where(F.col(turn) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
