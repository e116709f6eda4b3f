"""Operator 7: exact token counts at every prefix of a text, by prefix dynamic programming.

For each prefix of a word exactly one token can stand last: the one that neither
merges with, nor is cut by, the last token of the prefix before it.  So the count
at a position is the count at that token's start plus one, and one pass over the
word gives the count at all its positions; no prefix is encoded again.  A cut in
white space or inside a contraction or a special string changes how the text is
split there, which the positions concerned account for.

``count_tokens`` keeps the last position of each text, ``store_counts`` all of
them; ``cut_to_budget`` and ``counts_at`` answer from the stored counts.

Defined results: NULL text counts as empty (0 bytes, 0 tokens); NULL ids and
repeated rows are kept row by row; extra columns are not read.  Lone surrogates
cannot occur in Spark strings.  A count may fall where one more character
completes a longer token, so ``cut_to_budget`` takes the longest prefix within
the budget, not the first that exceeds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linktrove.llm.vocab import BYTE_PATTERN, EXOTIC, MergeList, Recent, WordSplit, bytes_of, letters_of, spaced_pieces

import regex

PART = 4096  # positions per stored row


class PrefixCounter:
    """Counts by a byte-level vocabulary file."""

    def __init__(self, path: str) -> None:
        self.merges = MergeList(path)
        self.split = WordSplit(self.merges, BYTE_PATTERN, lower=False)
        special = set(self.merges.special.values())
        #: token id by string, -1 for strings that only begin a token
        self.beginnings: dict[str, int] = {}
        for token, i in self.merges.vocab.items():
            if i not in special:
                for k in range(1, len(token)):
                    self.beginnings.setdefault(token[:k], -1)
                self.beginnings[token] = i
        self.finditer = regex.compile(BYTE_PATTERN).finditer
        self.fits = Recent(self._fits, limit=300_000)
        self.words = Recent(lambda w: self.states(w)[-1], limit=200_000)
        self.pieces = Recent(lambda p: self._piece(" " + p), limit=200_000)

    def _fits(self, pair: tuple[int, ...]) -> bool:
        """Whether these tokens come out again when their letters are merged."""
        letters = "".join(self.merges.surface[i] for i in pair)
        return self.merges.merge(self.merges.symbols(letters)) == list(pair)

    def states(self, letters: str) -> list[int]:
        """Token count of each prefix of a word, in byte letters, from the empty one on."""
        size, token_of, fits = len(letters), self.beginnings.get, self.fits
        counts, last = [0] + [None] * size, [-1] * (size + 1)
        for start in range(size):
            before, count, end = last[start], counts[start] + 1, start + 1
            while end <= size and (token := token_of(letters[start:end])) is not None:
                if token >= 0 and counts[end] is None and fits[(before, token) if start else (token,)]:
                    counts[end], last[end] = count, token
                end += 1
        return counts

    def _piece(self, piece: str) -> int:
        total = 0
        for special, part in self.split.parts(piece):
            total += 1 if special else sum(map(self.words.__getitem__, self.split.words(part)))
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        first, rest = spaced_pieces(text)
        return (self._piece(first) if first else 0) + sum(map(self.pieces.__getitem__, rest))

    def prefix_counts(self, text: str | None) -> np.ndarray:
        """Count of every prefix, by code points: element p belongs to text[:p]."""
        text = text or ""
        out = np.zeros(len(text) + 1, np.int64)
        at = total = 0
        for special, part in self.split.parts(text):
            if special:
                tail = at  # the last start of a word before it
                while tail and not (text[tail] == " " and not text[tail + 1].isspace()):
                    tail -= 1
                before = out[tail]
                for p in range(at + 1, at + len(part)):
                    out[p] = before + self._piece(text[tail:p])
                total += 1
                out[at + len(part)] = total
            else:
                total = self._segment(part, at, total, out)
            at += len(part)
        return out

    def _spans(self, part: str) -> Iterator[tuple[int, int]]:
        if not EXOTIC.search(part):
            yield from (m.span() for m in self.finditer(part))
        else:
            yield from (span for _, span in self.split.library.pre_tokenizer.pre_tokenize_str(part))

    def _segment(self, part: str, at: int, base: int, out: np.ndarray) -> int:
        """Fill the positions of a part without special strings; return the count behind it.

        It begins at ``at``, behind ``base`` tokens.
        """
        run_base = base
        run = None  # start of the white space that the next span touches
        for s, e in self._spans(part):
            word = part[s:e]
            states = np.asarray(self.states(letters_of(word)))
            out[at + s + 1:at + e + 1] = base + states[np.cumsum([len(c.encode()) for c in word])]
            if word in ("'re", "'ve", "'ll"):
                out[at + s + 2] = base + 2
            if run is not None:  # a cut inside or after white space leaves it in one piece
                to = e if word.isspace() else s + 1 if word[0].isspace() else s
                ends = np.cumsum([len(c.encode()) for c in part[run:to]])
                whole = np.asarray(self.states(letters_of(part[run:to])))
                out[at + s:at + to + 1] = run_base + whole[ends[s - run - 1:]]
            base += int(states[-1])
            if not word.isspace():
                run = None
            elif run is None:
                run, run_base = s, base - int(states[-1])
        return base


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter per worker and file."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def _source(docs: DataFrame, text: str, id: str) -> DataFrame:
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Bytes and tokens of each whole text, and whether it exceeds ``limit`` tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            n = [count(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    counted = _source(docs, text, id).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text"
    ).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


def store_counts(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """All prefix counts: rows (doc_id, first position, counts) of ``PART`` positions each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts_of = counter(path).prefix_counts
        for batch in batches:
            for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = counts_of(t)
                firsts = range(0, len(counts), PART)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id] * len(firsts), pa.int64()), pa.array(firsts, pa.int64()),
                     pa.array([counts[k:k + PART] for k in firsts], pa.list_(pa.int64()))],
                    names=["doc_id", "first", "counts"])

    return _source(docs, text, id).mapInArrow(run, "doc_id long, first long, counts array<long>")


def cut_to_budget(stored: DataFrame, budget: int) -> DataFrame:
    """Characters of the longest prefix of each document with at most ``budget`` tokens."""
    fits = F.transform("counts", lambda c, k: F.when(c <= F.lit(budget), F.col("first") + k))
    return stored.groupBy("doc_id").agg(F.max(F.array_max(fits)).alias("n_chars"))


def counts_at(stored: DataFrame, position: int) -> DataFrame:
    """Token count of each document's first ``position`` characters (all, where it has fewer)."""
    last = F.least(F.lit(position), F.col("first") + F.size("counts") - 1)
    return stored.where(F.col("first") <= position).groupBy("doc_id").agg(
        F.max_by(F.element_at("counts", (last - F.col("first") + 1).cast("int")), "first").alias("n_tokens"))
