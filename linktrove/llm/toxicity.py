"""Operator 10: toxicity by the nearest labelled examples under exact TF-IDF cosine.

Fit.  At most ``EXAMPLES`` labelled documents (by hash of their id) are the
examples.  Their words and word beginnings of 4 to 8 letters whose presence goes
with the label (chi-square of at least ``CHI``, at most ``TERMS`` of them) are the
terms; every other word counts for one common background term, so a vector
also says how dense its terms are.  Document frequencies are counted over all
documents.  Equal example vectors are one index entry with a number of votes.

Score.  The index keeps postings per term, and per block of entries the largest
weight of each term.  Blocks are visited by falling upper bound until none can
beat the entries at hand, so the ``VOTES`` nearest votes are exact.  Votes weigh by
closeness; entries as near as the last share what is left of the votes.  The
share of toxic votes, drawn slightly to the base rate, is mapped to a rate by a
monotone curve, fitted on the examples with their own vote left out; the nearest
examples are the evidence.

Collected and broadcast: the terms and the examples, both bounded by parameters.

Defined results: a NULL or wordless text scores the base rate; without examples
every score is 0.  NULL or other labels than 0 and 1 are not learnt from; a
doc_id labelled both ways counts as toxic.  Repeated rows score alike, NULL ids
are never held out.  Extra columns are not read (``keep_clean`` passes them on).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linktrove.llm.batches import slices
from linktrove.llm.vocab import Recent
from linktrove.operators.grouping import first_per_key
from linktrove.sources.scratch import materialize

EXAMPLES, TERMS, CHI, VOTES, BLOCK = 8000, 1024, 40.0, 15, 64
LIMIT = 0.7
WORD = re.compile(r"\w+")


def features(piece: str) -> list[str]:
    """Words of a piece of text, and their beginnings (marked with ^)."""
    out = []
    for w in WORD.findall(piece.lower()):
        out.append(w)
        out += ["^" + w[:k] for k in range(4, min(len(w), 9))]
    return out


class Model:
    """Terms, their weights and the block-max index over the examples."""

    def __init__(self, terms: list[str], idf: np.ndarray, examples: list[tuple[int, int, list, list]]) -> None:
        self.terms = {t: k + 1 for k, t in enumerate(terms)}  # 0 is the background term
        self.idf = idf
        votes: dict[tuple, list] = {}
        for doc_id, toxic, ids, counts in sorted(examples, key=lambda e: (e[0] is None, e[0])):
            key = self.vector(dict(zip(ids, counts)))
            entry = votes.setdefault(key, [0, 0, doc_id])
            entry[0] += 1
            entry[1] += toxic
        # alike entries lie in one block: by strongest term, then share of the background
        order = sorted(votes, key=lambda v: (max(v, key=lambda x: (x[0] > 0, x[1]), default=(0, 0)), v))
        self.mass = np.array([votes[v][0] for v in order], float)
        self.toxic = np.array([votes[v][1] for v in order], float)
        self.doc = [votes[v][2] for v in order]
        self.base = float(self.toxic.sum() / self.mass.sum()) if order else 0.0
        postings: dict[int, list] = {}
        for k, v in enumerate(order):
            for t, x in v:
                postings.setdefault(t, []).append((k, x))
        self.blocks = -(-len(order) // BLOCK)
        self.postings, self.tops = {}, {}
        for t, rows in postings.items():
            at, w = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
            tops = np.zeros(self.blocks)
            np.maximum.at(tops, at // BLOCK, w)
            self.postings[t] = at, w, np.searchsorted(at, np.arange(self.blocks + 1) * BLOCK)
            self.tops[t] = tops
        self.vectors = order
        self.calibrate()

    def vector(self, counts: dict[int, int]) -> tuple[tuple[int, float], ...]:
        """Unit vector of term counts, rounded so that equal texts agree everywhere."""
        v = {t: (1 + np.log(n)) * self.idf[t] for t, n in counts.items() if n}
        norm = float(np.sqrt(sum(x * x for x in v.values())))
        return tuple((t, round(float(x) / norm, 6)) for t, x in sorted(v.items())) if norm else ()

    def nearest(self, vector: tuple) -> list[tuple[float, list[int]]]:
        """Groups of entries of equal cosine, nearest first, until they hold ``VOTES`` votes."""
        bound = np.zeros(self.blocks)
        for t, x in vector:
            if t in self.tops:
                bound += x * self.tops[t]
        found: dict[float, list[int]] = {}
        reached = -1.0
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] < reached - 1e-9:
                break
            scores = np.zeros(min(BLOCK, len(self.mass) - b * BLOCK))
            for t, x in vector:
                if t in self.postings:
                    at, w, cut = self.postings[t]
                    part = slice(cut[b], cut[b + 1])
                    scores[at[part] - b * BLOCK] += x * w[part]
            for k in np.flatnonzero(scores >= max(reached, 0) - 1e-9):
                found.setdefault(round(float(scores[k]), 6), []).append(int(b * BLOCK + k))
            held = 0.0
            for s in sorted(found, reverse=True):
                held += self.mass[found[s]].sum()
                if held >= VOTES:
                    reached = s
                    found = {k: v for k, v in found.items() if k >= s}
                    break
        return sorted(((s, v) for s, v in found.items() if s > 0), reverse=True)

    def share(self, groups: list, without: tuple[int, int] | None = None) -> tuple[float, list[int]]:
        """Closeness-weighted share of toxic votes, and up to three nearest examples.

        ``without``: (entry, label) of one vote to leave out.
        """
        left, total, toxic, evidence = float(VOTES), 1.0, self.base, []
        for s, entries in groups:
            own = without is not None and without[0] in entries
            mass = float(self.mass[entries].sum()) - own
            if mass > 0:
                weight = min(left, mass) / (1.05 - min(s, 1.0))
                total += weight
                toxic += weight * (float(self.toxic[entries].sum()) - (without[1] if own else 0)) / mass
            evidence += [self.doc[k] for k in entries[:3]]
            left -= mass
            if left <= 0:
                break
        return min(1.0, max(0.0, toxic / total)), evidence[:3]

    def calibrate(self) -> None:
        """Monotone map from vote shares to label rates, by the examples' own shares without their vote."""
        points: dict[float, list[float]] = {}
        for k, v in enumerate(self.vectors):
            groups = self.nearest(v) if v else []
            for label, n in ((1, self.toxic[k]), (0, self.mass[k] - self.toxic[k])):
                if n:
                    at = points.setdefault(round(self.share(groups, (k, label))[0], 3), [0.0, 0.0])
                    at[0] += n
                    at[1] += n * label
        steps: list[list[float]] = []  # share, examples, toxic ones: pooled while rates fall
        for x in sorted(points):
            steps.append([x * points[x][0], *points[x]])
            while len(steps) > 1 and steps[-2][2] * steps[-1][1] >= steps[-1][2] * steps[-2][1]:
                last = steps.pop()
                steps[-1] = [a + b for a, b in zip(steps[-1], last)]
        self.curve = [0.0, *(s[0] / s[1] for s in steps), 1.0], [0.0, *((s[2] + self.base) / (s[1] + 1) for s in steps), 1.0]

    def score(self, vector: tuple) -> tuple[float, list[int]]:
        """Calibrated score and evidence; without any vote the base rate."""
        groups = self.nearest(vector) if vector else []
        if not groups:
            return self.base, []
        share, evidence = self.share(groups)
        return float(np.interp(share, *self.curve)), evidence


class Counted:
    """Term counts of whole texts; words are looked up once and kept in a bounded cache."""

    def __init__(self, terms: dict[str, int]) -> None:
        self.terms = terms
        self.pieces = Recent(self._piece, limit=100_000)

    def _piece(self, piece: str) -> tuple[int, ...]:
        return tuple(self.terms[f] for f in features(piece) if f in self.terms)

    def counts(self, text: str | None) -> dict[int, int]:
        pieces = (text or "").lower().split()
        found = list(map(self.pieces.__getitem__, pieces))
        out = Counter(t for f in found if f for t in f)
        plain = found.count(())
        if plain:
            out[0] = plain
        return out


def _in_training(id: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 3 != 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "toxic",
        examples: int = EXAMPLES) -> Model:
    spark = docs.sparkSession
    source = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = (labels.select(F.col(id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("toxic"))
             .where(F.col("toxic").isin(0, 1) & _in_training("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    here = known.join(source.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = first_per_key(here.withColumn("_one", F.lit(1)), ["_one"], [F.xxhash64("doc_id"), F.col("doc_id")], examples).drop("_one")
    # at most ``examples`` rows of two numbers
    sample = materialize(source.join(F.broadcast(materialize(chosen, "toxicity-chosen", spark)), "doc_id"), "toxicity-examples", spark)

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {0: Counter(), 1: Counter()}
        for rows in (part for batch in batches for part in slices(batch, 0)):
            for t, toxic in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                seen[toxic].update({f for p in set((t or "").lower().split()) for f in features(p)})
        both = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(both, pa.string()), pa.array([seen[1][f] for f in both], pa.int64()), pa.array([seen[0][f] for f in both], pa.int64())],
            names=["term", "a", "b"])

    sizes = sample.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    p, n = float(sizes[0] or 0), float(sizes[1] or 0)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    gap = a * n - b * p
    chi = gap * gap * (p + n) / (p * n * (a + b) * (p + n - a - b))
    terms = [r["term"] for r in sample.select("text", "toxic").mapInArrow(presence, "term string, a long, b long")
             .groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
             .where((F.col("a") + F.col("b") >= 4) & (F.col("a") + F.col("b") < p + n)).withColumn("chi", chi)
             .where(F.col("chi") >= CHI).orderBy(F.desc("chi"), "term").limit(TERMS).select("term").collect()] if p and n else []
    lookup = {t: k + 1 for k, t in enumerate(terms)}

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, seen, rows = Counted(lookup), Counter(), 0
        for part in (part for batch in batches for part in slices(batch, 0)):
            rows += part.num_rows
            for t in part.column(0).to_pylist():
                seen.update(counted.counts(t).keys())
        seen[-1] = rows
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

    df = {r["term"]: r["n"] for r in source.select("text").mapInArrow(frequencies, "term int, n long")
          .groupBy("term").agg(F.sum("n").alias("n")).collect()}
    rows = df.get(-1, 0)
    idf = np.array([1 + np.log((1 + rows) / (1 + df.get(k, 0))) for k in range(len(terms) + 1)])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = Counted(lookup)
        for part in (part for batch in batches for part in slices(batch, 1)):
            got = [counted.counts(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array([list(c) for c in got], pa.list_(pa.int32())),
                 pa.array([list(c.values()) for c in got], pa.list_(pa.int64()))], names=["doc_id", "toxic", "ids", "counts"])

    held = sample.select("doc_id", "text", "toxic").mapInArrow(vectors, "doc_id long, toxic int, ids array<int>, counts array<long>").collect()
    return Model(terms, idf, [(r["doc_id"], r["toxic"], r["ids"], r["counts"]) for r in held])


class Scorer:
    """Scores texts in a task; texts with equal vectors are scored once while the cache holds them."""

    def __init__(self, model: Model) -> None:
        self.model, self.counted = model, Counted(model.terms)
        self.known = Recent(model.score, limit=10_000, longest=1_000)

    def __call__(self, text: str | None) -> tuple[float, list[int]]:
        return self.known[self.model.vector(self.counted.counts(text))]


def score(docs: DataFrame, model: Model, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted and the evidence of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part in (part for batch in batches for part in slices(batch, 1)):
            got = [scorer(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([s for s, _ in got], pa.float64()), pa.array([e for _, e in got], pa.list_(pa.int64()))],
                names=["doc_id", "score", "evidence"])

    scored = source.mapInArrow(run, "doc_id long, score double, evidence array<long>")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= LIMIT).cast("int").alias("predicted"), "evidence")


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of documents that score below the limit, with all their columns; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part in (part for batch in batches for part in slices(batch, place)):
            yield part.filter(pa.array([scorer(t)[0] < LIMIT for t in part.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
