"""Operator 1: token ids in a binary file format, coded by a static range asymmetric numeral system.

One frequency table, counted over all ids, is shared by every block.  A block
holds the ids of consecutive documents (whole ones, at least ``BLOCK`` ids where
there are as many), dealt over ``LANES`` interleaved coder states, so that numpy
codes one id per lane at a time.  Every ``POINT`` ids a checkpoint keeps the lane
states, the place in the code words and the crc32 of the ids up to the next
checkpoint: a reader can start at any of them, and blocks are read in parallel.

Files are Parquet with one row per block; file order, then block order, is
ascending doc_id order.  Only the frequency table is collected and broadcast; it
has at most one row per vocabulary entry.

Defined results: NULL text counts as empty and holds the end id only.  NULL
doc_ids come first.  Repeated doc_ids lie side by side, in order of their ids.
An empty table gives no rows.  Extra columns are not read.  A damaged payload
raises ``ValueError``.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linktrove.llm.batches import joined, slices
from linktrove.llm.vocab import BYTE_PATTERN, EXOTIC, Recent, letters_of, spaced_pieces
from linktrove.sources.scratch import materialize, new_folder

BLOCK, POINT, LANES = 1 << 18, 1 << 17, 1024
SCALE = 20  # frequencies are shares of 2^SCALE
#: Marks that follow a word; none begins or ends a contraction or a special string of the public files.
MARKS = ".,;:!?)%#$&*"
#: Entries of one generation of a piece cache.
LIMIT = 400_000
#: Bytes of text encoded at a time (a longer text alone).
TEXT_BYTES = 1 << 23
#: White space beside a space or a line end may belong to one word with it; such texts are cut with care.
LOOSE = r"^[ \n]|[ \n]$|[ \n][ \n]|[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{3000}\x{feff}]"
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)


class IdEncoder:
    """Ids of a byte-level vocabulary file by the tokenizers library, many texts at a time.

    The texts of a batch are cut into pieces at spaces and line ends; each different
    piece is looked up once, and tokenized if it is not known.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.find = regex.compile(BYTE_PATTERN).findall
        self.words = Recent(self._word, limit=LIMIT // 2)
        self.marks = Recent(self._word, limit=10_000)
        #: ids by piece: behind a space, or behind a line end where the piece begins with it
        self.pieces = Recent(self._marked, limit=LIMIT)
        self.space, self.newline = letters_of(" "), self._word(letters_of("\n"))
        # the model's own cache is of no use behind these
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)

    def _bytes(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.dtype.itemsize == 2 else 'I'}", *ids)

    def _word(self, letters: str) -> bytes:
        return self._bytes([t.id for t in self.model.tokenize(letters)])

    def _marked(self, piece: str) -> bytes:
        """Ids of a piece behind a space, or of a line end and what follows it.

        Letters with marks behind are two words of ``BYTE_PATTERN``, the space
        with the letters and the marks, and hold no contraction or special string.
        """
        if piece[0] == "\n":
            before, first, space, piece = self.newline, "", "", piece[1:]
        else:
            before, first, space = b"", " ", self.space
        word = piece.rstrip(MARKS)
        if not word.isalpha() or not word.isascii() and EXOTIC.search(word):
            return before + self._piece(first + piece)
        ids = before + self._word(space + (word if word.isascii() else letters_of(word)))
        return ids + self.marks[piece[len(word):]] if len(word) < len(piece) else ids

    def _piece(self, piece: str) -> bytes:
        if EXOTIC.search(piece) or self.special is not None and self.special.search(piece):
            return self._bytes(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        return b"".join([self.words[letters_of(w)] for w in self.find(piece)])

    def encode_all(self, texts: pa.Array, end_id: int) -> pa.Array:
        """Ids of each text, ``end_id`` last; NULL counts as empty."""
        width, texts = self.dtype.itemsize, texts.cast(pa.string())
        loose = pc.fill_null(pc.match_substring_regex(texts, LOOSE), False)
        tame = pc.if_else(loose, "", pc.fill_null(texts, ""))
        # every line is a piece that begins with its line end, the first one too
        lines = pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(tame, "\n", " \n"), ""), " ")
        pieces = lines.flatten().dictionary_encode()
        known = self.pieces.all(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = pa.array(known, pa.binary()).take(pieces.indices)
        at = np.frombuffer(ids.buffers()[1], np.int32)[lines.offsets.to_numpy()]
        # the line end in front of the next text gives its place to the end id of this one
        data = np.append(np.frombuffer(joined(ids), self.dtype), self.dtype.type(0))
        data[at[1:] // width] = end_id
        out = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(at + np.int32(width)), pa.py_buffer(data)])
        if not pc.any(loose).as_py():
            return out
        end = self._bytes([end_id])
        return pa.array([self._loose(t.as_py()) + end if odd else x for t, odd, x in zip(texts, loose.to_pylist(), out.to_pylist())], pa.binary())

    def encode(self, text: str | None) -> bytes:
        """Ids of one text, without an end id."""
        return self.encode_all(pa.array([text], pa.string()), 0)[0].as_py()[:-self.dtype.itemsize]

    def _loose(self, text: str) -> bytes:
        first, rest = spaced_pieces(text)
        return (self._piece(first) if first else b"") + b"".join(self.pieces.all(rest))


_encoders: dict[str, IdEncoder] = {}


def encoder(path: str) -> IdEncoder:
    """One encoder per worker and file."""
    if path not in _encoders:
        _encoders[path] = IdEncoder(path)
    return _encoders[path]


def token_ids(docs: DataFrame, path: str, end_id: int, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, ids): little-endian ids of each document, the end id last."""
    source = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for part in slices(batch, 1, TEXT_BYTES, len(batch)):
                yield pa.RecordBatch.from_arrays([part.column(0), coder.encode_all(part.column(1), end_id)], names=["doc_id", "ids"])

    return source.mapInArrow(run, "doc_id long, ids binary")


def count_ids(ids: DataFrame, width: int) -> DataFrame:
    """(id, n) over all documents; each task adds up its own first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            part = np.bincount(np.frombuffer(joined(batch.column(0)), f"<u{width}"))
            if len(part) > len(total):
                total = np.concatenate([total, np.zeros(len(part) - len(total), np.int64)])
            total[:len(part)] += part
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    return ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


class Table:
    """Frequencies scaled to 2^SCALE; every counted id has at least one share."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(ids)
        self.ids, counts = ids[order].astype(np.int64), counts[order].astype(np.float64)
        total = 1 << SCALE
        if len(self.ids) > total:
            raise ValueError("more ids than shares")
        freq = np.maximum(1, np.floor(counts * (total / max(counts.sum(), 1)))).astype(np.int64)
        extra = total - int(freq.sum()) if len(freq) else 0
        for k in np.argsort(-freq, kind="stable"):  # the largest give or take what rounding left
            change = max(extra, 1 - int(freq[k]))
            freq[k] += change
            extra -= change
            if not extra:
                break
        size = int(self.ids.max()) + 1 if len(self.ids) else 0
        self.freq, self.start = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.freq[self.ids] = freq
        self.start[self.ids] = np.cumsum(freq) - freq
        self.slots = np.repeat(self.ids, freq).astype(np.uint32)


def encode_block(ids: np.ndarray, table: Table) -> tuple[bytes, list[tuple[int, bytes, int]]]:
    """Code words, and per checkpoint (place in the words, lane states, crc32 of its ids)."""
    shift, scale = np.uint64(63 - SCALE), np.uint64(SCALE)
    state = np.full(LANES, LOW, np.uint64)
    freq, start = table.freq[ids], table.start[ids]
    most = freq << shift
    if not freq.all():
        raise ValueError("an id is not in the frequency table")
    steps = -(-len(ids) // LANES)
    every = POINT // LANES
    emitted, count, points = [], 0, []
    for t in range(steps - 1, -1, -1):
        f, c = freq[t * LANES:(t + 1) * LANES], start[t * LANES:(t + 1) * LANES]
        x = state[:len(f)]
        full = np.flatnonzero(x >= most[t * LANES:(t + 1) * LANES])
        words = x[full]
        emitted.append(words.astype("<u4"))
        count += len(words)
        x[full] = words >> WORD
        q = x // f
        x[:] = (q << scale) + (x - q * f) + c
        if t % every == 0:
            crc = zlib.crc32(ids[t * LANES:(t + every) * LANES].astype("<u4"))
            points.append((count, state.astype("<u8").tobytes(), crc))
    points = [(count - place, states, crc) for place, states, crc in reversed(points)]
    return (np.concatenate(emitted[::-1]).tobytes() if emitted else b""), points


def decode_from(point: int, n_ids: int, payload: bytes, points: list, table: Table) -> Iterator[np.ndarray]:
    """Ids from checkpoint ``point`` on, one array per checkpoint; constant memory beyond the payload."""
    words = np.frombuffer(payload, "<u4")
    scale, mask = np.uint64(SCALE), np.uint64((1 << SCALE) - 1)
    place, states, _ = points[point]
    state = np.frombuffer(states, "<u8").astype(np.uint64)
    steps, every = -(-n_ids // LANES), POINT // LANES
    for k in range(point, len(points)):
        first, last = k * every, min(steps, (k + 1) * every)
        out = np.empty(min(n_ids, last * LANES) - first * LANES, np.uint32)
        for t in range(first, last):
            x = state[:min(LANES, n_ids - t * LANES)]
            slot = x & mask
            ids = table.slots[slot]
            out[(t - first) * LANES:(t - first) * LANES + len(x)] = ids
            x[:] = table.freq[ids] * (x >> scale) + slot - table.start[ids]
            low = np.flatnonzero(x < LOW)
            x[low] = (x[low] << WORD) | words[place:place + len(low)]
            place += len(low)
        if zlib.crc32(out.astype("<u4")) != points[k][2]:
            raise ValueError("ids do not match their checksum")
        yield out


BLOCK_COLUMNS = ("file long, block long, start long, n_ids long, doc_ids array<long>, lengths array<long>, "
                 "places array<long>, states array<binary>, crcs array<long>, payload binary, payload_crc long")


def write_blocks(ids: DataFrame, counts: DataFrame, width: int, folder: str) -> Table:
    """Write the blocks of all documents below ``folder``; returns the shared table.

    ``counts`` has one row per id in use, so at most the vocabulary's size.
    """
    spark = ids.sparkSession
    rows = counts.toPandas()
    table = Table(rows["id"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block, start = TaskContext.get().partitionId(), 0, 0
        docs, lengths, parts, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            payload, points = encode_block(np.concatenate(parts), shared.value)
            values = [file, block, start, held, docs, lengths, [p[0] for p in points], [p[1] for p in points],
                      [p[2] for p in points], payload, zlib.crc32(payload)]
            types = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 3 + [pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)],
                                              names=[c.split()[0] for c in BLOCK_COLUMNS.split(", ")])

        for batch in batches:
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(x.as_buffer(), f"<u{width}").astype(np.uint32)
                docs.append(doc_id)
                lengths.append(len(part))
                parts.append(part)
                held += len(part)
                if held >= BLOCK:
                    yield close()
                    block, start = block + 1, start + held
                    docs, lengths, parts, held = [], [], [], 0
        if docs:
            yield close()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = ids.select("doc_id", "ids").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(run, BLOCK_COLUMNS).write.parquet(folder)
    return table


def read_blocks(spark: SparkSession, folder: str, table: Table) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    blocks = spark.read.parquet(folder)
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if zlib.crc32(row["payload"]) != row["payload_crc"]:
                    raise ValueError("a block does not match its checksum")
                points = list(zip(row["places"], row["states"], row["crcs"]))
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                crcs, at, doc = [0] * len(ends), 0, 0
                for part in decode_from(0, row["n_ids"], row["payload"], points, shared.value):
                    data = memoryview(part.astype("<u4").tobytes())
                    until = at + len(part)
                    while doc < len(ends):
                        a, b = max(int(starts[doc]), at), min(int(ends[doc]), until)
                        crcs[doc] = zlib.crc32(data[4 * (a - at):4 * (b - at)], crcs[doc])
                        if ends[doc] > until:
                            break
                        doc += 1
                    at = until
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["file"]] * len(ends), pa.int64()), pa.array(row["doc_ids"], pa.int64()),
                     pa.array(starts + row["start"], pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(crcs, pa.int64())],
                    names=["file", "doc_id", "inside", "n_tokens", "ids_crc32"])

    decoded = blocks.mapInArrow(run, "file long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    # one row per file: ids of the files before it
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = blocks.groupBy("file").agg(F.sum("n_ids").alias("n")).select(
        "file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return decoded.join(files, "file").select(
        "doc_id", (F.col("inside") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def read_range(block: dict, table: Table, first: int, n: int) -> np.ndarray:
    """Ids ``first`` to ``first + n`` of one block row, decoded from the checkpoint before them."""
    points = list(zip(block["places"], block["states"], block["crcs"]))
    point = first // POINT
    out, at = [], point * POINT
    for part in decode_from(point, block["n_ids"], block["payload"], points, table):
        out.append(part)
        at += len(part)
        if at >= first + n:
            break
    return np.concatenate(out)[first - point * POINT:first - point * POINT + n] if out else np.zeros(0, np.uint32)


def token_files(docs: DataFrame, path: str, end_id: int = 0, folder: str | None = None,
                text: str = "text", id: str = "doc_id") -> DataFrame:
    """Encode all documents, write the files and read them back."""
    spark = docs.sparkSession
    width = encoder(path).dtype.itemsize
    ids = materialize(token_ids(docs, path, end_id, text, id), "token-ids", spark)
    folder = folder or new_folder(spark, "token-files")
    table = write_blocks(ids, count_ids(ids, width), width, folder)
    return read_blocks(spark, folder, table)
