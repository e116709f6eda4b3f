"""Operator 11: phrase collocations by weighted acyclic automata.

Shards of a bounded number of words sort their n-grams and build count transducers,
cut by prefix ranges: bounds (lang, word, word, word) drawn from evenly spaced words of
the corpus, so that a frequent first word or word pair spreads over ranges.  Per range the
transducers are united and their weights summed.  Phrases frequent enough become
candidates; the counts of their parts are read by composing the parts, sent to the
ranges that hold them, with the ranges' transducers.  Scores are exact decimals.

Defined results: NULL lang is ``und`` (and is one language with a literal ``und``), NULL
text is empty.  Repeated rows count as often as they stand.  Ids are not read, nor are
extra columns, whatever their names.  Words of any length and texts of any size are
counted whole; a text without words adds nothing.  An empty table gives no rows.
Scores are exact for counts up to 10^14 - 1.
"""

from __future__ import annotations

import bisect
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linktrove.llm.count_automata import Grams, Transducer, counted, union
from linktrove.operators.grouping import first_per_key
from linktrove.sources.scratch import materialize

LEAST = 10
BEST = 2000
#: Text bytes whose n-grams make up a range, and the number of ranges beyond which ranges grow instead.
RANGE_BYTES, MOST_RANGES = 8 << 20, 1 << 16
#: Words that sample the bounds, per range.
DRAWS = 16
#: Words of a shard, and bytes that are split into words at a time.
SHARD_WORDS, CHUNK = 1_500_000, 2 << 20
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BREAK = re.compile(rb"[.,;:!?\x0a-\x0d]+")
_GAP = re.compile(rb"[.,;:!?\x0a-\x0d\x20\x09]")
Bound = tuple[str, bytes, bytes, bytes]


def _chunks(text: bytes) -> Iterator[bytes]:
    """A text cut between words."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, min(at + CHUNK, len(text)))
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end


class Shard:
    """Word numbers of one language's texts; 0 ends a piece."""

    def __init__(self):
        self.number: dict[bytes, int] = {b"\n": 0}
        self.runs: list[np.ndarray] = []
        self.waiting: list[bytes] = []
        self.bytes = self.size = 0

    def add(self, text: bytes) -> None:
        self.waiting.append(text)
        self.bytes += len(text)
        if self.bytes >= CHUNK:
            self.read()

    def read(self) -> None:
        """Split what waits; the line ends between texts end pieces."""
        for part in _chunks(b"\n".join([*self.waiting, b""])):
            words = _BREAK.sub(b" \n ", part.translate(_LOWER)).replace(b"\t", b" ").split(b" ")
            coded = pa.array(words, pa.binary()).dictionary_encode()
            to = np.array([self.number.setdefault(w, len(self.number)) if w else -1 for w in coded.dictionary.to_pylist()], np.int64)
            run = to[coded.indices.to_numpy()]
            self.runs.append(run[run >= 0].astype(np.int32))
            self.size += len(self.runs[-1])
        self.waiting.clear()
        self.bytes = 0

    def grams(self) -> Grams:
        """Sorted n-grams of one to three words with counts."""
        self.read()
        words = list(self.number)[1:]
        order = sorted(range(len(words)), key=words.__getitem__)
        rank = np.zeros(len(words) + 1, np.int32)
        rank[np.array(order, np.int64) + 1] = np.arange(1, len(words) + 1)
        s = rank[np.concatenate([*self.runs, np.zeros(1, np.int32)])]
        one = s > 0
        two = one[:-1] & one[1:]
        three = two[:-1] & one[2:]
        none = np.zeros(len(s), np.int32)
        rows = [np.stack((s[one], none[one], none[one])), np.stack((s[:-1][two], s[1:][two], none[:-1][two])),
                np.stack((s[:-2][three], s[1:-1][three], s[2:][three]))]
        return counted([words[k] for k in order], np.concatenate(rows, axis=1))


def _cut(grams: Grams, bounds: list[Bound], lang: str) -> Iterator[tuple[int, Grams]]:
    """(range, its n-grams) of sorted n-grams of one language."""
    low = bisect.bisect_left(bounds, (lang,))
    high = bisect.bisect_left(bounds, (lang + "\0",))
    edges = [0]
    a, b, c = grams.labels
    for bound in bounds[low:high]:
        left, right = 0, len(a)
        for word, column in zip(bound[1:], (a, b, c)):
            # words of a bound are cut off: they need not be words of the corpus
            k = bisect.bisect_left(grams.words, word) + 1 if word else 0
            at = left + np.searchsorted(column[left:right], k)
            if not word or (k <= len(grams.words) and grams.words[k - 1] == word):
                left, right = at, left + np.searchsorted(column[left:right], k, "right")
            else:
                left = right = at
        edges.append(int(left))
    edges.append(len(a))
    for k, (x, y) in enumerate(zip(edges, edges[1:])):
        if x < y:
            part = grams.labels[:, x:y]
            used = np.zeros(len(grams.words) + 1, bool)
            used[part] = True
            used[0] = True
            to = np.cumsum(used, dtype=np.int32) - 1
            yield low + k, Grams([grams.words[w - 1] for w in np.flatnonzero(used)[1:].tolist()], to[part], grams.counts[x:y])


def _draws(batches: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    """One place per ``every`` bytes of text: the language and the three words from there, cut off at 32 bytes."""
    spent = every // 2
    for batch in batches:
        out = []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            data = text.as_buffer()
            spent += data.size
            while spent >= every:
                spent -= every
                at = min(spent, data.size)
                part = data.slice(data.size - at, min(at, 512)).to_pybytes().translate(_LOWER)
                gap = _GAP.search(part)
                words = _BREAK.split(part[gap.end() if gap else 0:].lstrip(b".,;:!?\n\x0b\x0c\r \t"), maxsplit=1)[0].split()[:3]
                out.append((lang, *([w[:32] for w in words] + [b""] * 3)[:3]))
        yield pa.record_batch([pa.array([o[0] for o in out], pa.string())] + [pa.array([o[k] for o in out], pa.binary()) for k in (1, 2, 3)],
                              names=["lang", "a", "b", "c"])


def range_bounds(rows: DataFrame, range_bytes: int = RANGE_BYTES) -> list[Bound]:
    """Bounds between ranges of about equal text, at most ``MOST_RANGES`` and that many draws of them on the driver."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MOST_RANGES, total // range_bytes + 1)
    every = max(1, total // (ranges * DRAWS))
    drawn = rows.mapInArrow(lambda b: _draws(b, every), "lang string, a binary, b binary, c binary").collect()
    seen = sorted((r.lang, bytes(r.a), bytes(r.b), bytes(r.c)) for r in drawn)
    return sorted({seen[k * len(seen) // ranges] for k in range(1, ranges)}) if seen else []


def _shards(batches: Iterator[pa.RecordBatch], bounds: list[Bound], most_words: int) -> Iterator[pa.RecordBatch]:
    shards: dict[str, Shard] = defaultdict(Shard)

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, shard in shards.items():
            for number, part in _cut(shard.grams(), bounds, lang):
                yield pa.record_batch([pa.array([number], pa.int32()), pa.array([lang], pa.string()),
                                       pa.array([Transducer.build(part).pack()], pa.binary())], names=["range", "lang", "counts"])
        shards.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            shards[lang].add(text.as_py())
            if sum(s.size for s in shards.values()) >= most_words:
                yield from flush()
    yield from flush()


_UNITED = "range int, lang string, counts binary, phrase binary, n_words int, f long, total long"


def _unite(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Per (range, lang), in order: its transducer, the words it counts, and its frequent phrases."""
    names = [c.split()[0] for c in _UNITED.split(", ")]
    types = [pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64()]
    key, whole, waiting = None, None, []

    def gather() -> None:
        nonlocal whole
        whole = union([*([whole] if whole else []), *waiting])
        waiting.clear()

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal whole
        if waiting:
            gather()
        if whole:
            single = int(whole.counts[whole.labels[1] == 0].sum())
            rows = [(*key, Transducer.build(whole).pack(), None, None, None, single)]
            often = np.flatnonzero((whole.counts >= least) & (whole.labels[1] > 0))
            for (a, b, c), f in zip(whole.labels[:, often].T.tolist(), whole.counts[often].tolist()):
                words = [whole.words[k - 1] for k in (a, b, c) if k]
                rows.append((*key, None, b" ".join(words), len(words), f, None))
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)
        whole = None

    for batch in batches:
        for number, lang, counts in zip(*(batch.column(k) for k in ("range", "lang", "counts"))):
            now = (number.as_py(), lang.as_py())
            if now != key:
                yield from close()
                key = now
            waiting.append(Transducer.unpack(counts.as_py()).grams())
            # unite when as much waits as is united: every row is sorted a few times only
            if sum(len(w.counts) for w in waiting) > max(1 << 19, len(whole.counts) if whole else 0):
                gather()
    yield from close()


def _route(batches: Iterator[pa.RecordBatch], bounds: list[Bound]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places = [bisect.bisect_right(bounds, (lang, *(phrase.split(b" ") + [b"", b""])[:3]))
                  for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("part").to_pylist())]
        yield pa.record_batch([pa.array(places, pa.int32()), batch.column("lang"), batch.column("part")], names=["range", "lang", "part"])


def _compose(parts: pa.Table, counts: pa.Table) -> pa.Table:
    """Weights of the parts that lie in one range, by language."""
    held = {row["lang"]: row["counts"] for row in counts.to_pylist()}
    langs = np.array(parts.column("lang").to_pylist(), object)
    phrases = parts.column("part").to_pylist()
    out = np.zeros(len(phrases), np.int64)
    for lang in set(langs):
        at = np.flatnonzero(langs == lang)
        if lang in held:
            out[at] = Transducer.unpack(held[lang]).weights([phrases[k].split(b" ") for k in at])
    return pa.table([parts.column("lang"), parts.column("part"), pa.array(out)], names=["lang", "part", "f"])


def count_transducers(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST,
                      range_bytes: int = RANGE_BYTES, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, list[Bound]]:
    """Stored table of the ranges' transducers, word totals and frequent phrases, and the bounds of the ranges."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    bounds = range_bounds(rows, range_bytes)
    shards = rows.mapInArrow(lambda b: _shards(b, bounds, shard_words), "range int, lang string, counts binary")
    ordered = shards.repartition(len(bounds) + 1, "range").sortWithinPartitions("range", "lang")
    return materialize(ordered.mapInArrow(lambda b: _unite(b, least), _UNITED), "automata"), bounds


def part_counts(united: DataFrame, bounds: list[Bound], parts: DataFrame) -> DataFrame:
    """(lang, part, f) of distinct (lang, part): composition with the transducers of the ranges they lie in."""
    routed = parts.mapInArrow(lambda b: _route(b, bounds), "range int, lang string, part binary")
    held = united.where(F.col("counts").isNotNull()).select("range", "lang", "counts")
    return routed.groupBy("range").cogroup(held.groupBy("range")).applyInArrow(_compose, "lang string, part binary, f long")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, best: int = BEST,
                 **sizes: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of two to three words of each language."""
    united, bounds = count_transducers(docs, text, lang, least, **sizes)
    totals = united.where(F.col("total").isNotNull()).groupBy("lang").agg(F.sum("total").alias("n"))
    found = united.where(F.col("phrase").isNotNull()).select("lang", "phrase", "n_words", F.col("f").alias("a"))
    words = F.split(F.col("phrase").cast("string"), " ", -1)

    def part(start: int, size) -> F.Column:
        return F.array_join(F.slice(words, start, size), " ").cast("binary")

    # a pair that lies in a longer candidate at least half as frequent goes
    longer = found.where("n_words = 3").select("lang", F.explode(F.array(part(1, 2), part(2, 2))).alias("inner"), "a")
    most = longer.groupBy("lang", "inner").agg(F.max("a").alias("most")).withColumnRenamed("lang", "in_lang")
    kept = found.join(most, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("inner")), "left").where(
        F.coalesce(100 * F.col("most") < 50 * F.col("a"), F.lit(True))).drop("in_lang", "inner", "most")

    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1))).select(
        "lang", "phrase", "a", "k", part(1, F.col("k")).alias("left"),
        F.array_join(F.slice(words, F.col("k") + 1, F.col("n_words") - F.col("k")), " ").cast("binary").alias("right"))
    parts = cuts.select("lang", F.explode(F.array("left", "right")).alias("part")).distinct()
    counts = materialize(part_counts(united, bounds, parts), "parts")
    for side in ("left", "right"):
        known = counts.select(F.col("lang").alias("in_lang"), F.col("part").alias("in_part"), F.col("f").alias(side[0]))
        cuts = cuts.join(known, (F.col("lang") == F.col("in_lang")) & (F.col(side) == F.col("in_part"))).drop("in_lang", "in_part")

    def whole(name: str) -> F.Column:
        return F.col(name).cast("decimal(14,0)")

    exact = cuts.withColumn("top", F.lit(1_000_000).cast("decimal(7,0)") * whole("a") * whole("a")).withColumn("under", whole("l") * whole("r"))
    scored = exact.withColumn("score", F.expr("top div under")).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rows = scored.select("lang", F.col("phrase").cast("string").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    ranked = first_per_key(rows, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], best, "rank")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
