"""Operator 3: mixing sources to target weights by cube-method balanced sampling.

Every source gets a share of the mix by weight, at most twice its own size; what
is above goes to the others by weight.  A document is taken floor(pi) times, and
once more with the fractional part of pi = target / source size.  The cube
method draws these extra copies: inclusion probabilities move along directions
that change neither the expected number of documents nor that of words, until
they are 0 or 1.  It works on blocks of at most about ``BLOCK`` documents of one
source; at most two documents of a block stay fractional, and they meet those
of other blocks in the next round.  The last two of a source are landed, and
draws of its last block exchanged, where the words come nearest to the target
and the number of documents stays less than one from its expectation.

Defined results: NULL text has size 0, NULL source is a source of its own, in
the last place.  Documents without words have size 0 and are taken 0 words.
Repeated rows are drawn one by one.  Draws depend on the rows alone, so reruns
agree.  An empty table gives no rows.  Extra columns are not read
(``mixed_documents`` passes them on).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linktrove.llm.batches import unused
from linktrove.sources.scratch import materialize

WEIGHTS, TOTAL, MOST = (5, 2, 1), 1.5, 2
BLOCK = 512
#: Fixed value: a word is a run of characters other than these spaces.
WORD = r"[^\x20\x09-\x0D]+"
NEAR = 1e-9


def positions(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows numbered from 0 in order, without passing all through one task."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges", spark)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return placed.withColumn("_inside", inside).join(sizes, "_part").withColumn(
        name, F.col("_inside") + F.col("_before")).drop("_part", "_inside", "_before")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source, n, source_size, target) per source from rows (source, size)."""
    spark = sizes.sparkSession
    sources = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    ranked = positions(sources, [F.col("source").isNull(), F.col("source")], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = materialize(ranked.withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double")), "sources", spark)
    level, capped = 0.0, -1
    while True:  # what capped sources leave is shared by weight among the others
        over = F.col("cap") <= level * F.col("weight")
        got = weighed.agg(F.sum("source_size"), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight"))),
                          F.count(F.when(over, 1))).first()
        if got[3] == capped or not got[2]:
            break
        capped = got[3]
        level = (total * (got[0] or 0) - (got[1] or 0.0)) / got[2]
    share = F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    return weighed.select("source", "n", "source_size", share.alias("target"))


def flight(p: np.ndarray, size: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Move probabilities to 0 or 1, keeping their sum and the expected size; at most two stay between."""
    p = p.copy()
    hand: list[int] = []
    for k in np.flatnonzero((p > NEAR) & (p < 1 - NEAR)):
        hand.append(int(k))
        while len(hand) == 3:
            a, b, c = (float(size[i]) for i in hand)
            u = np.array([c - b, a - c, b - a]) if not a == b == c else np.array([1.0, -1.0, 0.0])
            q = p[hand]
            with np.errstate(divide="ignore", invalid="ignore"):
                up = float(np.min(np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf))))
                down = float(np.min(np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf))))
            q = q + (up if draw.random() * (up + down) < down else -down) * u
            q[q < NEAR], q[q > 1 - NEAR] = 0.0, 1.0
            p[hand] = q
            hand = [i for i in hand if 0 < p[i] < 1]
    return p


def land(p: np.ndarray, size: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Settle the at most two last probabilities, then exchange draws while that brings the words nearer.

    The number of documents stays less than one from its expectation.
    ``expected``: the probabilities before the flight; only fractional ones may change.
    """
    p = p.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    options = [[(m >> i) & 1 for i in range(len(open_))] for m in range(1 << len(open_))]
    count = round(float(p[open_].sum()))
    p[open_] = min(options, key=lambda s: (abs(sum(s) - count), abs(float(((s - p[open_]) * size[open_]).sum())), s))
    free = np.flatnonzero((expected > NEAR) & (expected < 1 - NEAR))
    alone = np.eye(len(free), dtype=bool)
    while len(free):
        error, number = float(((p - expected) * size).sum()), float((p - expected).sum())
        turn = 1 - 2 * p[free]
        step = turn * size[free]
        # one draw or two at once; a block bounds the pairs
        after = np.abs(error + step[:, None] + np.where(alone, 0.0, step[None, :]))
        after[np.abs(number + turn[:, None] + np.where(alone, 0.0, turn[None, :])) >= 1] = np.inf
        i, j = np.unravel_index(int(np.argmin(after)), after.shape)
        if after[i, j] >= abs(error) - NEAR:
            break
        for k in {int(i), int(j)}:
            p[free[k]] = 1 - p[free[k]]
    return p


def _round(units: DataFrame, seed: int) -> DataFrame:
    """One flight per (source, block); a source's only block is landed."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("doc_id", "ascending"), ("size", "ascending")])
        if not table.num_rows:
            return table
        source, block = table["source"][0].as_py(), table["block"][0].as_py()
        draw = np.random.default_rng([seed, zlib.crc32((source or "").encode()), source is None, block])
        size = table["size"].to_numpy()
        expected = table["p"].to_numpy()
        p = flight(expected, size, draw)
        if table["blocks"][0].as_py() == 1:
            p = land(p, size, expected)
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))

    return units.groupBy("source", "block").applyInArrow(run, units.schema)


def mix(docs: DataFrame, text: str = "text", id: str = "doc_id", source: str = "source", seed: int = 7,
        weights: tuple = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every document."""
    spark = docs.sparkSession
    sizes = materialize(docs.select(
        F.col(id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes", spark)
    wanted = materialize(targets(sizes, weights, total, most), "targets", spark)
    pi = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    h = F.xxhash64(F.lit(seed), "doc_id", "size")
    same = F.col("source").eqNullSafe(F.col("_source"))
    units = (sizes.join(wanted.withColumnRenamed("source", "_source"), same).drop("_source").withColumn("h", h)
             .withColumn("sure", F.floor(pi).cast("int")).withColumn("p", pi - F.floor(pi))
             .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("long")).withColumn("block", F.pmod("h", "blocks")))
    settled = None
    turn = 0
    while True:
        done = materialize(_round(units, seed + turn), "flight", spark)
        whole = (F.col("p") == 0) | (F.col("p") == 1)
        settled = done.where(whole) if settled is None else settled.union(done.where(whole))
        rest = done.where(~whole)
        if rest.isEmpty():
            break
        # two of each block at most, so these blocks are no larger
        units = rest.withColumn("block", F.floor(F.col("block") / (BLOCK // 2)).cast("long")).withColumn(
            "blocks", F.ceil(F.col("blocks") / (BLOCK // 2)).cast("long"))
        turn += 1
    copies = (F.col("sure") + F.col("p").cast("int")).alias("copies")
    return settled.select("doc_id", "source", "size", "source_size", "target", copies).withColumn(
        "taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, text: str = "text", id: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The rows of the mix, repeated as often as they are taken, with all their columns."""
    k_id, k_source, k_size, turn, m_id, m_source, m_size, m_turn, times, copy = unused(
        docs.columns, "id", "source", "size", "turn", "mix_id", "mix_source", "mix_size", "mix_turn", "times", "copy")
    copies = mix(docs, text, id, source, **options).where("copies > 0").select(
        F.col("doc_id").alias(m_id), F.col("source").alias(m_source), F.col("size").alias(m_size), F.col("copies").alias(times))
    # rows with equal id, source and size stand for each other
    copies = copies.withColumn(m_turn, F.row_number().over(Window.partitionBy(m_id, m_source, m_size).orderBy(F.desc(times))))
    rows = docs.withColumns({
        k_id: F.col(id).cast("long"), k_source: F.col(source).cast("string"),
        k_size: F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")})
    rows = rows.withColumn(turn, F.row_number().over(Window.partitionBy(k_id, k_source, k_size).orderBy(F.xxhash64(F.col(text)))))
    match = (F.col(k_id).eqNullSafe(F.col(m_id)) & F.col(k_source).eqNullSafe(F.col(m_source))
             & (F.col(k_size) == F.col(m_size)) & (F.col(turn) == F.col(m_turn)))
    taken = rows.join(copies, match).withColumn(copy, F.explode(F.sequence(F.lit(1), times)))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns])
