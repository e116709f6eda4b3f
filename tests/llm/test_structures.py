"""Phrase collocations, conversation tries and line dedup against brute force."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from linktrove.llm import collocations, conversation_trie, line_dedup
from linktrove.llm.count_automata import Grams, Transducer, union

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_phrases(rows, least, best):
    counts = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(UP)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            for k in (1, 2, 3):
                counts["und" if lang is None else lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        some = []
        for g, a in f.items():
            if len(g) == 1 or a < least:
                continue
            if any(c >= least and 100 * c >= 50 * a and len(t) == 3 and len(g) == 2 and g in (t[:2], t[1:]) for t, c in f.items()):
                continue
            score, k = min((1000000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            some.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, r + 1, p.decode(), -a, left, right, n, -s) for r, (s, a, p, left, right) in enumerate(sorted(some)[:best])]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"range_bytes": 300, "shard_words": 40}])
def test_collocations(spark, odd, sizes):
    draw = np.random.default_rng(5)
    words = ["The", "the", "a", "é", "日本", "x" * 300, "\x00", "b\x1cb", "of"]
    rows = [(None, None), ("en", ""), ("en", " \t ."), (None, "of the of the of the, of the"), ("und", "of the"), ("", "a a a a a")]
    for k in range(60):
        rows.append((["en", "fr", None][k % 3], "".join(words[i] + " \t  .,\n\x0b"[j:j + 1 + j % 2] for i, j in draw.integers(0, [9, 7], (40, 2)))))
    rows.append(("en", "the a " * 30_000))
    docs = spark.createDataFrame([(t, x, 1, "p") for x, t in rows], "text string, lang string, f int, phrase string")
    got = sorted(tuple(r) for r in collocations.collocations(docs, least=3, best=12, **sizes).collect())
    assert got == brute_phrases(rows, 3, 12)
    odd_rows = [(r.lang, r.text) for r in odd.collect()]
    assert sorted(map(tuple, collocations.collocations(odd, **sizes).collect())) == brute_phrases(odd_rows, 10, 2000)
    assert collocations.collocations(docs.limit(0), **sizes).count() == 0


def test_transducers_of_any_split_agree():
    draw = np.random.default_rng(1)
    tokens = [[b"w%d" % k for k in draw.integers(0, 30, 400)] for _ in range(5)]
    total = collections.Counter()
    parts = []
    for t in tokens:
        shard = collocations.Shard()
        shard.add(b" ".join(t))
        parts.append(Transducer.unpack(Transducer.build(shard.grams()).pack()).grams())
        total.update(tuple(t[i:i + k]) for k in (1, 2, 3) for i in range(len(t) - k + 1))
    whole = union(parts)
    names = [tuple(whole.words[x - 1] for x in row if x) for row in whole.labels.T]
    assert dict(zip(names, whole.counts.tolist())) == dict(total) and names == sorted(names)
    automaton = Transducer.build(whole)
    asked = [list(g) for g in total] + [[b"nope"], [b"w1", b"nope"], [b"w1", b"w2", b"zz"]]
    assert automaton.weights(asked).tolist() == [total[tuple(g)] for g in asked]
    bounds = sorted(("x", *g, *[b""] * (3 - len(g))) for g in itertools.islice(total, 0, None, 97))
    cut = [p for _, p in collocations._cut(whole, bounds, "x")]
    assert len(cut) > 5 and (union(cut).counts == whole.counts).all() and union(cut).words == whole.words


def test_equal_states_are_stored_once():
    rows = np.array([[1, 0, 0], [1, 2, 0], [1, 2, 3], [2, 0, 0], [2, 2, 0], [2, 2, 3], [3, 0, 0]], np.int32).T
    built = Transducer.build(Grams([b"a", b"b", b"c"], rows, np.array([5, 2, 2, 4, 2, 2, 9])))
    assert [len(v.offsets) - 1 for v in built.levels] == [1, 1, 1] and built.weights([[b"a", b"b", b"c"], [b"c"]]).tolist() == [2, 9]


def brute_trie(rows):
    said = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            digest = hashlib.md5(f"{len(r or '')}:{r or ''}{x or ''}".encode()).digest()
            said[c].append((t is not None, t or 0, r or "", digest, x or ""))
    said = {c: [(v[2], v[4]) for v in sorted(s)] for c, s in said.items()}
    built = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 9
        leader = c - int(np.fmod(c, 5))
        built[c] = tuple(said.get(leader, [])[:h] + own[h:])
    nodes = collections.defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
    out = []
    for s, members in nodes.items():
        under = [t for t in nodes if t[:len(s)] == s]
        kids = [t for t in under if len(t) == len(s) + 1]
        leaves = sum(1 for t in under if not any(v[:len(t)] == t and len(v) == len(t) + 1 for v in under))
        saved = sum((len(nodes[t]) - 1) * len(t[-1][1].encode()) for t in under if t)
        ends = ",".join(str(c) for c in sorted(c for c in members if built[c] == s))
        out.append((min(members), len(s), min(nodes[s[:-1]]) if s else None, len(members), len(kids), leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("container", [1, 7, 200_000])
def test_trie(spark, container):
    draw = np.random.default_rng(4)
    rows = [(None, 1, "user", "lost"), (3, None, None, None), (3, None, None, None), (3, 1, "user", "a"), (-7, 0, "user", "é"), (-7, 1, "x", None)]
    for c in range(10, 60):
        rows += [(c, t, ["user", "assistant"][t % 2], "ab"[draw.integers(0, 2)] * 3) for t in range(draw.integers(1, 14))]
    rows += [(c, t, "user", f"same {t}") for c in (100, 105, 110, 115, 120) for t in range(40)]
    rows += [(200, t, None, "long" * 500) for t in range(300)]
    turns = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, path string, depth int")
    got = sorted((tuple(r) for r in conversation_trie.trie_nodes(turns, container=container).collect()), key=repr)
    assert got == brute_trie(rows)
    assert conversation_trie.trie_nodes(turns.limit(0), container=container).count() == 0


def test_line_dedup(spark, odd):
    common, shared = "\tThe common line that all of these documents hold \r", "é" * 40
    rows = [(k, f"own {k}\n{common if k % 2 else common.upper().strip()}\n{shared if k < 5 else ''}\n{common}") for k in range(12)]
    rows += [(None, f"{common}\nkept"), (None, f"{common}\nkept"), (3, f"{common}\nanother row of document 3\n"), (50, None), (51, ""),
             (52, ("short\n" * 5000) + shared + "\n" + "z" * 100_000 + "\n"), (53, "x" * 39 + "\n" + "x" * 39)]
    rows += [(60 + k, "x" * 39 + "\n" + "y" * 40) for k in range(4)]

    def brute(rows, least_docs):
        keys = [[line.strip(" \t\n\x0b\x0c\r").translate(UP) for line in (t or "").split("\n")] for _, t in rows]
        held = collections.defaultdict(set)
        for (i, _), ks in zip(rows, keys):
            for k in ks:
                held[k].add(-10**9 if i is None else i)
        out = []
        for (i, t), ks in zip(rows, keys):
            stay = [not (len(k) >= 40 and len(held[k]) >= least_docs and max(held[k]) != (-10**9 if i is None else i)) for k in ks]
            text = "\n".join(x for x, s in zip((t or "").split("\n"), stay) if s)
            out.append((i, len(ks), len(ks) - sum(stay), hashlib.sha256(text.encode()).hexdigest()))
        return sorted(out, key=repr)

    docs = spark.createDataFrame([(*r, b"clash", 1, "k") for r in rows], "doc_id long, text string, hash binary, pos int, digest string")
    for least in (1, 5, 6):
        got = sorted((tuple(r) for r in line_dedup.dedup_lines(docs, least_docs=least).collect()), key=repr)
        assert got == brute(rows, least)
    odd_rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted((tuple(r) for r in line_dedup.dedup_lines(odd, least_docs=2).collect()), key=repr) == brute(odd_rows, 2)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    maps = line_dedup.with_bitmaps(docs.where("doc_id = 0")).first()
    assert maps.keep is None and maps.dropped == 0


def test_line_dedup_stays_native(spark, odd):
    plan = line_dedup.dedup_lines(odd)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
