"""Token operators against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from linktrove.llm import bpe_stream, prefix_counts, rans_files
from linktrove.llm.batches import joined
from linktrove.llm.vocab import vocabulary_path

BYTE, WORD = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("word_bpe_49k.json")


def texts():
    draw = random.Random(5)
    pieces = ["the", " ", "  ", "\n", "'re", "'ve", "'", "l", "1", "<|endoftext|>", "<|startoftext|>", "ing", "!", " a", "é", "日本", "\x1c", "İ", "́"]
    out = ["", " lead", "a" * 3000, "It's  we'RE\t\r\n'S'll 12345 ß ẞ"]
    out += ["".join(draw.choice(pieces) for _ in range(25)) for _ in range(60)]
    return out + ["".join(draw.choice("abehtniosr") for _ in range(2500)) for _ in range(5)]


def le32(ids):
    return np.array(ids, "<u4").tobytes()


def test_transducer_equals_library():
    library, own = Tokenizer.from_file(WORD), bpe_stream.codec(WORD)
    for t in texts():
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == le32(ids), t
        assert "".join(own.decode(le32(ids), step=3)) == library.decode(ids, skip_special_tokens=False)


def test_byte_decoder_waits_for_whole_characters():
    library = Tokenizer.from_file(BYTE)
    decoder = bpe_stream.Decoder(bpe_stream.MergeList(BYTE))
    ids = library.encode("日本語 é", add_special_tokens=False).ids
    assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == "日本語 é"


def test_counts_of_every_prefix():
    library, own = Tokenizer.from_file(BYTE), prefix_counts.counter(BYTE)
    for t in texts():
        assert own.count(t) == len(library.encode(t, add_special_tokens=False).ids)
        if len(t) < 100:
            assert list(own.prefix_counts(t)) == [len(library.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)], t


def test_budget_and_stored_counts(spark, docs):
    library = Tokenizer.from_file(BYTE)
    few = docs.limit(5)
    stored = prefix_counts.store_counts(few, BYTE).cache()
    cut = {r.doc_id: r.n_chars for r in prefix_counts.cut_to_budget(stored, 20).collect()}
    for r in few.collect():
        n = [len(library.encode(r.text[:k], add_special_tokens=False).ids) for k in range(min(len(r.text), 200) + 1)]
        assert cut[r.doc_id] == max(k for k, v in enumerate(n) if v <= 20)


def test_rans_blocks_round_trip_from_any_checkpoint(monkeypatch):
    monkeypatch.setattr(rans_files, "POINT", 4096)
    draw = np.random.default_rng(1)
    ids = (draw.zipf(1.3, 20_001) % 500).astype(np.uint32)
    seen, counts = np.unique(ids, return_counts=True)
    table = rans_files.Table(seen, counts)
    payload, points = rans_files.encode_block(ids, table)
    assert np.array_equal(np.concatenate(list(rans_files.decode_from(0, len(ids), payload, points, table))), ids)
    block = {"places": [p[0] for p in points], "states": [p[1] for p in points], "crcs": [p[2] for p in points], "n_ids": len(ids), "payload": payload}
    assert np.array_equal(rans_files.read_range(block, table, 9000, 50), ids[9000:9050])
    with pytest.raises(ValueError):
        list(rans_files.decode_from(0, len(ids), bytes(len(payload)), points, table))


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_queries_equal_brute_force(spark, request, which):
    rows = request.getfixturevalue(which)
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    source = sorted(rows.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    start, want1, want7, want8 = 0, [], [], []
    for r in source:
        t = r.text or ""
        ids = byte.encode(t, add_special_tokens=False).ids
        want1.append((r.doc_id, len(ids) + 1, zlib.crc32(le32([*ids, 0]))))
        want7.append((r.doc_id, len(t.encode()), len(ids), len(ids) > 1024))
        words = word.encode(t, add_special_tokens=False).ids
        text = word.decode(words, skip_special_tokens=False)
        want8.append((r.doc_id, len(words), hashlib.sha256(le32(words)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = rans_files.token_files(rows, BYTE).collect()
    assert sorted(map(repr, [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got])) == sorted(map(repr, want1))
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    assert sorted(map(repr, map(tuple, prefix_counts.count_tokens(rows, BYTE).collect()))) == sorted(map(repr, want7))
    assert sorted(map(repr, map(tuple, bpe_stream.codec_digests(rows, WORD).collect()))) == sorted(map(repr, want8))
    encoded = bpe_stream.encode_documents(rows, WORD)
    assert bpe_stream.decode_documents(encoded, WORD).count() == len(source)


def test_empty_table(spark, docs):
    none = docs.limit(0)
    assert rans_files.token_files(none, BYTE).count() == 0
    assert prefix_counts.count_tokens(none, BYTE).count() == 0
    assert bpe_stream.codec_digests(none, WORD).count() == 0


def test_encoder_cuts_texts_as_the_library_does(monkeypatch):
    monkeypatch.setattr(rans_files, "LIMIT", 40)
    coder, library = rans_files.IdEncoder(BYTE), Tokenizer.from_file(BYTE)
    draw = random.Random(3)
    parts = ["one", "été", "Two", ".", ",", "%%%", "#", "'s", "'", "\n", "\n\n", " ", "  ", "\t", "\x1c", " ", "\xa0", "7", "<|endoftext|>", "<|", "|>", "字", "don't", "ªº", "x²"]
    for _ in range(4000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(1, 12)))
        assert np.frombuffer(coder.encode(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_ids_of_a_batch_are_counted_in_one_go():
    values = pa.array([b"ab", b"", b"cdef", b"g"])
    assert joined(values).to_pybytes() == b"abcdefg" and joined(values[1:3]).to_pybytes() == b"cdef"
    assert joined(values[:0]).to_pybytes() == b""


def test_a_batch_is_encoded_piece_by_different_piece(monkeypatch):
    coder, library = rans_files.IdEncoder(BYTE), Tokenizer.from_file(BYTE)
    made = []
    make = coder.pieces.make
    monkeypatch.setattr(coder.pieces, "make", lambda piece: made.append(piece) or make(piece))
    batch = ["one two, two\ntwo", None, "", "two two, two <|endoftext|>", "\n", " two", "two  one\t", "a b", "été 字 two,", "one\none two"] * 3
    got = coder.encode_all(pa.array(["cut off", *batch], pa.string()).slice(1), 7)
    for text, ids in zip(batch, got.to_pylist(), strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u2").tolist() == [*want, 7], repr(text)
    assert len(made) == len(set(made)) and {"two,", "\ntwo", "two"} <= set(made) and "off" not in made
    assert coder.encode_all(pa.array(batch, pa.large_string()), 7).equals(got)
    assert coder.encode_all(pa.array([], pa.string()), 7).to_pylist() == []
