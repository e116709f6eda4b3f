"""Weighted acyclic automata over words: phrases of one to three words with their counts.

A transducer maps a phrase to its count: three levels of arcs (label, weight, target),
labels sorted within a state, equal states of a level stored once.  It is built from
sorted n-grams, added to others by a union that sums weights, and composed with a list
of phrases to read their weights.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import zstandard

#: Labels that still fit three to a sort key.
PACK = 21
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


@dataclass
class Grams:
    """Rows of one to three labels (0 is none, k is words[k - 1]) with counts; words are sorted."""

    words: list[bytes]
    labels: np.ndarray  # 3 x n, int32
    counts: np.ndarray  # int64

    def merged(self) -> Grams:
        """Rows in order, equal ones summed."""
        if not len(self.counts):
            return self
        if len(self.words) < 1 << PACK:
            keys = packed(self.labels)
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            new = keys[1:] != keys[:-1]
        else:
            order = np.lexsort(self.labels[::-1])
            new = (self.labels[:, order[1:]] != self.labels[:, order[:-1]]).any(axis=0)
        first = np.concatenate(([0], np.flatnonzero(new) + 1))
        return Grams(self.words, self.labels[:, order[first]], np.add.reduceat(self.counts[order], first))


def packed(labels: np.ndarray) -> np.ndarray:
    a, b, c = labels.astype(np.int64)
    return a << 2 * PACK | b << PACK | c


def counted(words: list[bytes], labels: np.ndarray) -> Grams:
    """Rows that count one each: sorted, equal ones counted."""
    if len(words) >= 1 << PACK or not labels.shape[1]:
        return Grams(words, labels, np.ones(labels.shape[1], np.int64)).merged()
    keys = np.sort(packed(labels))
    first = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
    counts = np.diff(np.concatenate((first, [len(keys)])))
    keys, mask = keys[first], (1 << PACK) - 1
    return Grams(words, np.stack((keys >> 2 * PACK, keys >> PACK & mask, keys & mask)).astype(np.int32), counts)


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    h = x.astype(np.uint64) * _MIX[k]
    h ^= h >> np.uint64(29)
    h *= _MIX[(k + 1) % 3]
    return h ^ h >> np.uint64(32)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs, one after the other."""
    total = int(lengths.sum())
    before = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) if total else np.zeros(0, np.int64)
    return before + np.arange(total)


@dataclass
class Level:
    """States as runs of arcs; ``offsets`` has one entry more than there are states."""

    offsets: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    targets: np.ndarray

    def folded(self) -> tuple[Level, np.ndarray]:
        """Equal states once, and the state that stands for each old one."""
        starts, lengths = self.offsets[:-1], np.diff(self.offsets)
        if not len(starts):
            return self, np.zeros(0, np.int64)
        arcs = np.stack([self.labels, self.weights, self.targets + 1])
        sign = np.add.reduceat(_mixed(arcs[0], 0) ^ _mixed(arcs[1], 1) ^ _mixed(arcs[2], 2), starts)
        _, first, which = np.unique(sign, return_index=True, return_inverse=True)
        like = first[which]
        # a signature may clash: states that differ from their stand-in stand for themselves
        same = lengths == lengths[like]
        test = np.flatnonzero(same)
        differ = (arcs[:, _spread(starts[test], lengths[test])] != arcs[:, _spread(starts[like[test]], lengths[test])]).any(axis=0)
        same[np.repeat(test, lengths[test])[differ]] = False
        like = np.where(same, like, np.arange(len(like)))
        kept, number = np.unique(like, return_inverse=True)
        at = _spread(starts[kept], lengths[kept])
        offsets = np.concatenate(([0], np.cumsum(lengths[kept])))
        return Level(offsets, self.labels[at], self.weights[at], self.targets[at]), number


@dataclass
class Transducer:
    words: list[bytes]
    levels: list[Level]

    @classmethod
    def build(cls, grams: Grams) -> Transducer:
        """From sorted n-grams without repeats.  Prefixes that are not n-grams here weigh 0."""
        a, b, c = grams.labels
        levels = []
        changed = [a[1:] != a[:-1]]
        changed.append(changed[0] | (b[1:] != b[:-1]))
        last = np.zeros(0, np.int64)
        # from the last words to the first ones: arcs of a level, grouped by the prefix they leave
        for depth, label in ((2, c), (1, b), (0, a)):
            if depth == 2:
                arcs = np.flatnonzero(label > 0)
                weights, targets = grams.counts[arcs], np.full(len(arcs), -1)
            else:
                first = np.concatenate((np.ones(min(1, len(a)), bool), changed[depth]))
                node = np.cumsum(first) - 1
                arcs = np.flatnonzero(first)
                weights = np.where((grams.labels[depth + 1:, arcs] == 0).all(axis=0), grams.counts[arcs], 0)
                targets = np.full(len(arcs), -1)
                targets[node[last_rows]] = last
                real = label[arcs] > 0
                arcs, weights, targets = arcs[real], weights[real], targets[real]
            prefix = np.zeros(len(arcs), np.int64)
            if depth:
                prefix = (np.cumsum(np.concatenate((np.ones(min(1, len(a)), bool), changed[depth - 1]))) - 1)[arcs]
            starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(arcs)), bool), prefix[1:] != prefix[:-1])))
            level = Level(np.concatenate((starts, [len(arcs)])) if len(arcs) else np.zeros(1, np.int64),
                          label[arcs].astype(np.int64), weights, targets)
            last_rows = arcs[starts] if len(arcs) else arcs
            level, last = level.folded()
            levels.append(level)
        return cls(grams.words, levels[::-1])

    def grams(self) -> Grams:
        """All n-grams with a weight, in no set order."""
        rows, counts = [], []
        prefix = np.zeros((0, 1), np.int64)
        state = np.zeros(1, np.int64) if len(self.levels[0].labels) else np.zeros(0, np.int64)
        prefix = prefix[:, :len(state)]
        for depth, level in enumerate(self.levels):
            lengths = level.offsets[state + 1] - level.offsets[state]
            at = _spread(level.offsets[state], lengths)
            prefix = np.concatenate((np.repeat(prefix, lengths, axis=1), level.labels[at][None]))
            weights = level.weights[at]
            real = weights > 0
            rows.append(np.concatenate((prefix[:, real], np.zeros((2 - depth, int(real.sum())), np.int64))).astype(np.int32))
            counts.append(weights[real])
            on = level.targets[at] >= 0
            state, prefix = level.targets[at][on], prefix[:, on]
        return Grams(self.words, np.concatenate(rows, axis=1), np.concatenate(counts))

    def weights(self, phrases: list[list[bytes]]) -> np.ndarray:
        """Composition with phrases of one to three words: their weights, 0 where there is no path."""
        number = {w: k + 1 for k, w in enumerate(self.words)}
        state = np.zeros(len(phrases), np.int64) if len(self.levels[0].labels) else np.full(len(phrases), -1)
        out = np.zeros(len(phrases), np.int64)
        for depth, level in enumerate(self.levels):
            arc_state = np.repeat(np.arange(len(level.offsets) - 1), np.diff(level.offsets))
            arcs = arc_state << 32 | level.labels
            label = np.array([number.get(p[depth], 0) if len(p) > depth else 0 for p in phrases], np.int64)
            wanted = state << 32 | label
            at = np.minimum(np.searchsorted(arcs, wanted), max(len(arcs) - 1, 0))
            found = (state >= 0) & (label > 0) & ((arcs[at] == wanted) if len(arcs) else False)
            ends = found & (np.array([len(p) for p in phrases]) == depth + 1)
            out[ends] = level.weights[at[ends]]
            state = np.where(found, level.targets[at] if len(arcs) else -1, -1)
        return out

    def pack(self) -> bytes:
        arrays = [x for v in self.levels for x in (v.offsets, v.labels, v.weights, v.targets)]
        parts = [b" ".join(self.words)]
        for x in arrays:
            small = not len(x) or int(x.max()) < 1 << 31
            parts.append((b"4" if small else b"8") + x.astype("<i4" if small else "<i8").tobytes())
        head = struct.pack(f"<I{len(parts)}q", len(self.words), *map(len, parts))
        return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))

    @classmethod
    def unpack(cls, blob: bytes) -> Transducer:
        data = zstandard.ZstdDecompressor().decompress(blob)
        n, *lengths = struct.unpack_from("<I13q", data)
        at = struct.calcsize("<I13q")
        parts = []
        for length in lengths:
            parts.append(data[at:at + length])
            at += length
        arrays = [np.frombuffer(p, "<i4" if p[:1] == b"4" else "<i8", offset=1).astype(np.int64) for p in parts[1:]]
        return cls(parts[0].split(b" ") if n else [], [Level(*arrays[k:k + 4]) for k in (0, 4, 8)])


def union(parts: list[Grams]) -> Grams:
    """Sum of weighted n-grams over the sorted union of their words."""
    if len(parts) == 1:
        return parts[0].merged()
    words = sorted(set().union(*(p.words for p in parts)))
    number = {w: k + 1 for k, w in enumerate(words)}
    labels = []
    for p in parts:
        to = np.zeros(len(p.words) + 1, np.int32)
        to[1:] = np.fromiter((number[w] for w in p.words), np.int32, len(p.words))
        labels.append(to[p.labels])
    return Grams(words, np.concatenate(labels, axis=1), np.concatenate([p.counts for p in parts])).merged()
