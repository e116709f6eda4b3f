"""Operator 8: BPE as a bounded-lookahead transducer, and decoding by a state machine.

Encoding.  How far can text that is still to come change a merge result?  A new
symbol merges with a piece ``u`` (rule r1); the piece to its left then misses
the partner it would have had in a later rule r2, which frees its own left
neighbour for a rule r3, and so on: ranks grow along the chain, and the right
part of each rule starts with the left part of the one before.  The longest
such chain, in symbols, is the merge list's sufficient lookahead; boundaries at
least that far from the end of the known text are final.  The transducer keeps a
window of a fixed multiple of it, emits what is final and forgets it.

Decoding.  Ids become bytes or surface strings one by one; an incomplete
character waits in the state machine.

Defined results: NULL text counts as empty and has no ids; its digests are those
of no bytes.  Repeated rows give repeated results; NULL ids are kept.  Extra
columns are not read.  A text of any length is held once; beyond it a
window and a bounded cache are kept.
"""

from __future__ import annotations

import codecs
import hashlib
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linktrove.llm.vocab import ODD_SPACE, WORD_PATTERN, MergeList, Recent, WordSplit, bytes_of


def sufficient_lookahead(merges: MergeList) -> int:
    """Symbols of later text that can move a boundary (see the module's text)."""
    def spell(token: str) -> str:
        if merges.end and token.endswith(merges.end):
            body = token[:-len(merges.end)]
            return body[:-1] + chr(0xE000 + ord(body[-1]))
        return token

    reach: dict[str, int] = {}
    most = 1
    for left, right in merges.rules:
        u, v = spell(left), spell(right)
        here = len(u) + max((reach.get(v[:k], 0) for k in range(1, len(v) + 1)), default=0)
        reach[u] = max(reach.get(u, 0), here)
        most = max(most, here)
    return most


class Transducer:
    """Symbols of one word in, final token ids out; memory is one window."""

    def __init__(self, merges: MergeList, lookahead: int | None = None) -> None:
        self.merges = merges
        self.lookahead = lookahead or sufficient_lookahead(merges)
        self.window = 2 * self.lookahead + 64
        self.width = {i: self._width(t) for t, i in merges.vocab.items()}
        self.held: list[int] = []

    def _width(self, token: str) -> int:
        end = self.merges.end
        return len(token) - len(end) if end and token.endswith(end) and token != end else len(token)

    def feed(self, symbols: Iterable[int]) -> Iterator[int]:
        """Take symbols that are followed by more of the same word."""
        for s in symbols:
            self.held.append(s)
            if len(self.held) >= self.window:
                yield from self._settle()

    def _settle(self) -> Iterator[int]:
        final, at = len(self.held) - self.lookahead, 0
        for token in self.merges.merge(self.held):
            if at + self.width[token] > final:
                break
            at += self.width[token]
            yield token
        self.held = self.held[at:]

    def finish(self, last: int | None = None) -> list[int]:
        """End of the word; ``last`` is its last symbol."""
        if last is not None:
            self.held.append(last)
        out, self.held = self.merges.merge(self.held), []
        return out


class Decoder:
    """Ids in, text out, piece by piece."""

    def __init__(self, merges: MergeList) -> None:
        self.joined = merges.spec.get("decoder") is None
        self.surface = {i: t.encode() for i, t in merges.surface.items()} if self.joined else {
            i: bytes_of(t) if i not in merges.special.values() else t.encode() for i, t in merges.surface.items()}
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def feed(self, ids: Iterable[int]) -> str:
        """Without a decoder rule in the file, tokens are joined by one space."""
        data = (b" " if self.joined else b"").join(map(self.surface.__getitem__, ids))
        if self.joined and data:
            data = b" " + data if self.begun else data
            self.begun = True
        return self.state.decode(data)

    def finish(self) -> str:
        out = self.state.decode(b"", True)
        self.state.reset()
        self.begun = False
        return out


class Codec:
    """Encoder and decoder of one vocabulary file with word ends (white space dropped)."""

    def __init__(self, path: str) -> None:
        self.merges = MergeList(path)
        self.split = WordSplit(self.merges, WORD_PATTERN, lower=True)
        self.transducer = Transducer(self.merges)
        self.words = Recent(self._word)
        self.pieces = Recent(self._piece)
        self.decoder = Decoder(self.merges)

    def _word(self, letters: str) -> bytes:
        symbols = self.merges.symbols(letters)
        if len(symbols) < self.transducer.window:  # nothing can be emitted before the end
            return struct.pack(f"<{len(ids)}I", *ids) if (ids := self.merges.merge(symbols)) else b""
        return b"".join(i.to_bytes(4, "little") for i in [*self.transducer.feed(symbols[:-1]), *self.transducer.finish(symbols[-1])])

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():
            return self.words[piece.lower()]
        out = []
        for special, part in self.split.parts(piece):
            if special:
                out.append(self.merges.special[part].to_bytes(4, "little"))
            else:
                out += map(self.words.__getitem__, self.split.words(part))
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if ODD_SPACE.search(text):  # white space for Python only
            return self._piece(text)
        return b"".join(map(self.pieces.__getitem__, text.split()))

    def decode(self, ids: bytes, step: int = 65_536) -> Iterator[str]:
        numbers = memoryview(ids).cast("I")
        for k in range(0, len(numbers), step):
            yield self.decoder.feed(numbers[k:k + step])
        yield self.decoder.finish()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker and file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, ids binary of little-endian 32-bit ids) per document."""
    source = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            ids = [coder.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return source.mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from the rows of ``encode_documents``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            texts = ["".join(coder.decode(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def codec_digests(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Token count and digests of the ids and of the text decoded from them, in one pass."""
    source = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            counts, id_digests, text_digests = [], [], []
            for t in batch.column(1).to_pylist():
                ids = coder.encode(t)
                digest = hashlib.sha256()
                for piece in coder.decode(ids):
                    digest.update(piece.encode())
                counts.append(len(ids) // 4)
                id_digests.append(hashlib.sha256(ids).hexdigest())
                text_digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_digests), pa.array(text_digests)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
