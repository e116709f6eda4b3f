"""Winnowed pieces of texts, and automata over short phrases.

For a piece length k and a window of w pieces, the piece with the least hash of
each window is kept, about 2 / (w + 1) of all.  Two texts that share w + k - 1
characters in a row share the kept piece of that window.
"""

import sys
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# tasks get these functions whole, so that workers need not import this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: (piece, window) by the length that is sure to share a kept piece.
GUARANTEES = {k + w - 1: (k, w) for k, w in ((4, 5), (8, 9), (16, 33))}
#: Phrases of one automaton, all shorter than the least guarantee; more of them take further automata.
AUTOMATON = 50_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def kept_pieces(text: str, k: int, w: int) -> np.ndarray:
    """Hashes of the kept pieces of a text; none if it is shorter than the guarantee."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    n = len(codes) - k + 1
    if n < w:
        return np.zeros(0, np.int64)
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = (h ^ codes[j:j + n]) * _FACTOR
        h ^= h >> np.uint64(29)
    return np.unique(np.lib.stride_tricks.sliding_window_view(h, w).min(axis=1)).view(np.int64)


def pieces(df: DataFrame, text: str, of: Column, sizes: list[int], longest_only: bool = False) -> DataFrame:
    """(_of, _piece): kept pieces for the guarantees ``sizes``, or for the longest one that fits each text."""
    rows = df.select(of.alias("_of"), F.col(text).alias("_text")).where("_text IS NOT NULL")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("_text")
            for at in range(0, len(column), 256):
                found = []
                for value in column.slice(at, 256):
                    known = value.as_py()
                    fit = [s for s in sizes if s <= len(known)]
                    kept = [kept_pieces(known, *GUARANTEES[s]) for s in (fit[-1:] if longest_only else fit)]
                    found.append(np.concatenate(kept) if kept else np.zeros(0, np.int64))
                which = np.repeat(np.arange(len(found)) + at, [len(x) for x in found])
                yield pa.record_batch([batch.column("_of").take(pa.array(which)), pa.array(np.concatenate(found), pa.int64())],
                                      names=["_of", "_piece"])

    kind = rows.schema["_of"].dataType.simpleString()
    return rows.mapInArrow(cut, f"_of {kind}, _piece long")


def guarantees_used(phrases: DataFrame) -> list[int]:
    """Guarantees that phrases (column ``_phrase``) are looked up by: the longest that fits each, so a few numbers."""
    size = F.greatest(*[F.when(F.length("_phrase") >= s, F.lit(s)) for s in GUARANTEES], F.lit(0))
    return sorted(r[0] for r in phrases.select(size.alias("s")).distinct().collect() if r[0])


def short_flags(phrases: DataFrame) -> list[Callable[[Column], Column]]:
    """Functions "text contains one of these": one for each block of about ``AUTOMATON`` short phrases."""
    blocks = -(-phrases.count() // AUTOMATON)
    flags = []
    for k in range(blocks):
        block = phrases.where(F.pmod(F.xxhash64("_phrase"), F.lit(blocks)) == k)
        flags.append(_flag([r[0] for r in block.collect()]))
    return flags


def _flag(phrases: list[str]) -> Callable[[Column], Column]:
    def contains(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()
        for phrase in phrases:
            automaton.add_word(phrase, True)
        automaton.make_automaton()
        for series in texts:
            yield pd.Series([isinstance(t, str) and next(automaton.iter(t), None) is not None for t in series], dtype=bool)

    contains.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(contains, "boolean")
