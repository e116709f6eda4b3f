"""Operator 5: URL filters by a Bloom filter cascade.

The first Bloom filter encodes the listed keys.  Keys of the corpus that it takes
for listed without being so are encoded in the second, listed keys that the second
takes for those in the third, and so on until a filter errs on no key.  The
number of filters that a key passes then tells exactly, for every key that occurs
in the corpus, whether it is listed; URLs meet no table.

Keys are 128-bit hashes of strings.  A rule ``host/path`` is listed under its
action; a URL asks for every suffix of its host with every path beginning of a
length that a rule has, under either action, and for every suffix alone, which is
how whole hosts are blocked.  The longest rule wins, then the longer host.

Filters grow with the listed keys.  Up to ``BITS`` bits a filter is broadcast;
beyond that its words are joined by number, with the same answers.

Defined results: NULL URLs and URLs without ``://`` have empty host and path and
are allowed.  A path-less URL has an empty path, which no rule begins.  Repeated
rows are judged alike; NULL ids are kept; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linktrove.sources.scratch import materialize

BITS = 1 << 28
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` (ASCII lower case) and ``path``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substr(F.col(url), at + F.lit(3))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return urls.withColumn("host", F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER)).withColumn(
        "path", F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")))


def suffixes(host: str) -> list[str]:
    labels = host.split(".")
    return [".".join(labels[k:]) for k in range(len(labels))] if host else []


def candidates(host: str, path: str, lengths: list[int]) -> list[tuple[int, int, str, str]]:
    """(length of the rule, of its host, rule, key) of everything that may be listed for a URL."""
    out = []
    for s in suffixes(host):
        out.append((0, len(s), "", f"host {s}"))
        for n in lengths:
            if len(path) >= n:
                rule = s + path[:n]
                out += [(len(rule), len(s), rule, f"{action} {rule}") for action in ("allow", "block")]
    return out


def hashed(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k) for k in keys), "<i8").reshape(-1, 2)
    return digests[:, 0], digests[:, 1]


class Filter:
    """Bits and hash count of one level."""

    def __init__(self, n: int, rate: float) -> None:
        self.k = max(1, round(-np.log2(rate)))
        self.bits = 64 * (int(np.ceil(max(n, 1) * self.k / np.log(2))) // 64 + 1)
        self.words: np.ndarray | None = None  # absent while too large to broadcast
        self.table: DataFrame | None = None

    def places(self, level: int, a: Column, b: Column) -> list[Column]:
        """Bit numbers of a key in this level."""
        return [F.pmod(F.xxhash64(F.lit(level), F.lit(i), a, b), F.lit(self.bits)) for i in range(self.k)]

    def contain(self, places: np.ndarray) -> np.ndarray:
        """Whether all bits of each key (rows of bit numbers) are set."""
        bits = (self.words[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)
        return (bits > 0).all(axis=1)


class Cascade:
    """Levels of filters, built over a listed and an unlisted set of keys (columns a, b)."""

    def __init__(self, listed: DataFrame, universe: DataFrame, bits: int = BITS) -> None:
        self.levels: list[Filter] = []
        spark = listed.sparkSession
        inside = materialize(listed.select("a", "b").distinct(), "listed-keys", spark)
        outside = materialize(universe.select("a", "b").distinct().join(inside, ["a", "b"], "left_anti"), "other-keys", spark)
        n, others = inside.count(), outside.count()
        rate = min(0.5, 0.7 * n / max(others, 1)) if n else 0.5
        while n:
            level = Filter(n, rate)
            places = inside.select(F.explode(F.array(*level.places(len(self.levels), F.col("a"), F.col("b")))).alias("place"))
            words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(
                F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("bits"))
            if level.bits <= bits:  # collected: a bounded bit field
                rows = words.toPandas()
                field = np.zeros(level.bits // 64, np.int64)
                field[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
                level.words = field.view(np.uint64)
            else:
                level.table = materialize(words, "filter-words", spark)
            self.levels.append(level)
            passed = materialize(self.passing(outside, len(self.levels) - 1), "passed", spark)
            inside, outside, n, rate = passed, inside, passed.count(), 0.5

    def passing(self, keys: DataFrame, number: int) -> DataFrame:
        """The keys that one level takes for its own."""
        level = self.levels[number]
        if level.words is not None:
            shared = keys.sparkSession.sparkContext.broadcast(level)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    places = np.stack([c.to_numpy() for c in batch.columns[2:]], axis=1)
                    hit = pa.array(shared.value.contain(places), pa.bool_())
                    yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(hit)

            placed = keys.select("a", "b", *[p.alias(f"p{i}") for i, p in enumerate(level.places(number, F.col("a"), F.col("b")))])
            return placed.mapInArrow(run, "a long, b long")
        asked = keys.select("a", "b", F.posexplode(F.array(*level.places(number, F.col("a"), F.col("b")))).alias("i", "place")).withColumn(
            "word", F.shiftright("place", 6))
        is_set = F.expr("getbit(bits, cast(place % 64 as int)) = 1")
        return asked.join(level.table, "word").where(is_set).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == level.k).select("a", "b")

    def listed(self, keys: DataFrame) -> DataFrame:
        """(a, b) of the distinct keys that are listed; exact for keys of the universe."""
        left, found = keys.select("a", "b").distinct(), None
        for number in range(len(self.levels)):
            passed = self.passing(left, number)
            if number % 2 == 0:  # in, unless a later level says otherwise
                stay = passed
                out = self.passing(passed, number + 1) if number + 1 < len(self.levels) else None
                here = stay if out is None else stay.join(out, ["a", "b"], "left_anti")
                found = here if found is None else found.union(here)
                left = out if out is not None else left
        return found if found is not None else keys.select("a", "b").limit(0)


def universe_of(urls: DataFrame, lengths: list[int]) -> DataFrame:
    """Keys (a, b) that the URLs ask for, each once per batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = {c[3] for h, p in set(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())) for c in candidates(h, p, lengths)}
            a, b = hashed(list(keys))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return urls.select("host", "path").mapInArrow(run, "a long, b long")


def keys_of(strings: DataFrame, name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = hashed(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return strings.where(F.col(name).isNotNull()).select(name).mapInArrow(run, "a long, b long")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], blocked_hosts: DataFrame | None = None,
          url: str = "url", id: str = "page_id", bits: int = BITS) -> DataFrame:
    """host, path, rule and verdict of every URL.

    ``rules``: (action, host, path).  ``blocked_hosts``: rows (host), blocked with
    their subdomains where no rule fits.
    """
    spark = pages.sparkSession
    lengths = sorted({len(path) for _, _, path in rules})
    parsed = host_and_path(pages.select(F.col(id).alias("page_id"), F.col(url).alias("url"))).select("page_id", "host", "path")
    strings = spark.createDataFrame([(f"{action} {host}{path}",) for action, host, path in rules], "k string")
    if blocked_hosts is not None:
        strings = strings.union(blocked_hosts.where(F.col("host") != "").select(F.concat(F.lit("host "), "host")))
    cascade = Cascade(keys_of(strings, "k"), universe_of(parsed, lengths), bits)

    if all(level.words is not None for level in cascade.levels):
        shared = spark.sparkContext.broadcast(cascade.levels)
        ask = parsed.mapInArrow(lambda batches: _ask(batches, lengths), _ASKED)
        # bit numbers of every key in every level, made where the rows are; no exchange
        numbers = [F.transform("keys", _places_in(level, n)).alias(f"level{n}") for n, level in enumerate(cascade.levels)]
        return ask.select("page_id", "host", "path", "rules", *numbers).mapInArrow(
            lambda batches: _answer(batches, shared.value), "page_id long, host string, path string, rule string, verdict string")
    ask = materialize(parsed.mapInArrow(lambda batches: _ask(batches, lengths), _ASKED), "asked-keys", spark)
    known = materialize(cascade.listed(ask.select(F.inline("keys"))), "answered", spark)
    places = materialize(ask.select("host", "path", "rules", "keys").distinct().select(
        "host", "path", F.explode(F.arrays_zip("rules", "keys")).alias("x")), "places", spark)
    hit = places.select("host", "path", F.col("x.rules").alias("r"), F.col("x.keys.a").alias("a"), F.col("x.keys.b").alias("b")).join(known, ["a", "b"])
    best = hit.groupBy("host", "path").agg(F.max("r").alias("r"))
    return ask.select("page_id", "host", "path").join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.when(F.col("r.rule") != "", F.col("r.rule")).alias("rule"),
        F.coalesce(F.col("r.action"), F.lit("allow")).alias("verdict"))


def _places_in(level: Filter, number: int) -> Callable[[Column], Column]:
    return lambda key: F.array(*level.places(number, key["a"], key["b"]))


_RULE = "struct<n: int, h: int, rule: string, action: string>"
_ASKED = f"page_id long, host string, path string, rules array<{_RULE}>, keys array<struct<a: long, b: long>>"


def _ask(batches: Iterator[pa.RecordBatch], lengths: list[int]) -> Iterator[pa.RecordBatch]:
    rule = pa.struct([("n", pa.int32()), ("h", pa.int32()), ("rule", pa.string()), ("action", pa.string())])
    for batch in batches:
        rules, keys = [], []
        for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            found = candidates(h, p, lengths)
            a, b = hashed([c[3] for c in found])
            rules.append([{"n": c[0], "h": c[1], "rule": c[2], "action": "block" if c[3].startswith("host ") else c[3][:5]} for c in found])
            keys.append([{"a": int(x), "b": int(y)} for x, y in zip(a, b)])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(rules, pa.list_(rule)), pa.array(keys, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))],
            names=["page_id", "host", "path", "rules", "keys"])


def _answer(batches: Iterator[pa.RecordBatch], levels: list[Filter]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        named, verdicts = [], []
        for rules, *numbers in zip(*(c.to_pylist() for c in batch.columns[3:])):
            passed, inside = np.ones(len(rules), bool), np.zeros(len(rules), bool)
            for n, level in enumerate(levels if rules else []):
                passed &= level.contain(np.array(numbers[n], np.int64))
                inside[passed] = n % 2 == 0
            best = max(((r["n"], r["h"], r["rule"], r["action"]) for r, hit in zip(rules, inside) if hit), default=(0, 0, "", "allow"))
            named.append(best[2] or None)
            verdicts.append(best[3])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(named, pa.string()), pa.array(verdicts, pa.string())],
                                         names=["page_id", "host", "path", "rule", "verdict"])
