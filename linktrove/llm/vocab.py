"""Shared parts of the token operators: vocabulary files, byte mapping, bounded caches."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import regex


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file; the files are never copied into the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter that a byte-level vocabulary writes for each byte value."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    spare = (b for b in range(256) if b not in letters)
    letters.update({b: chr(256 + k) for k, b in enumerate(spare)})
    return [letters[b] for b in range(256)]


LETTERS = byte_letters()
TO_LETTERS = dict(enumerate(LETTERS))
FROM_LETTER = {c: b for b, c in enumerate(LETTERS)}

#: Beyond these blocks character classes may differ between Unicode versions,
#: so such pieces are split by the tokenizer library itself.
EXOTIC = re.compile("[^\x00-ɏ]")


def letters_of(text: str) -> str:
    return text.encode("utf-8", "replace").decode("latin-1").translate(TO_LETTERS)


def bytes_of(token: str) -> bytes:
    return bytes(FROM_LETTER[c] for c in token)


class Recent(dict):
    """Values by key, made when first asked for; two generations bound its size.

    A key that was not asked for while ``limit`` others came in is forgotten.
    Keys longer than ``longest`` are never kept.
    """

    def __init__(self, make: Callable, limit: int = 250_000, longest: int = 64) -> None:
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value

    def all(self, keys: list) -> list:
        """Values of many keys."""
        found = list(map(self.get, keys))
        for k, value in enumerate(found):
            if value is None:
                found[k] = self[keys[k]]
        return found


class MergeList:
    """Vocabulary and ranked merges of a BPE tokenizer file.

    Symbols and tokens are ids.  ``end`` is the mark on a word's last symbol
    (empty when the vocabulary has none).
    """

    NONE = 1 << 60

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.spec = spec
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.surface = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.rules = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for k, (left, right) in enumerate(self.rules):
            self.rank[self.vocab[left], self.vocab[right]] = k
            self.made.append(self.vocab[left + right])
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def symbols(self, letters: str) -> list[int]:
        """One id per byte letter; the last carries the end mark."""
        vocab = self.vocab
        out = [vocab[c] for c in letters]
        if self.end and letters:
            out[-1] = vocab[letters[-1] + self.end]
        return out

    def merge(self, symbols: list[int]) -> list[int]:
        """Lowest rank first, leftmost among equals, until no pair has a rule."""
        rank, made, none = self.rank.get, self.made, self.NONE
        s = list(symbols)
        r = [rank(pair, none) for pair in zip(s, s[1:])]
        while r and (low := min(r)) != none:
            i = r.index(low)
            s[i:i + 2] = [made[low]]
            del r[i]
            if i:
                r[i - 1] = rank((s[i - 1], s[i]), none)
            if i < len(r):
                r[i] = rank((s[i], s[i + 1]), none)
        return s


class WordSplit:
    """Cuts a text into the pieces that a tokenizer file merges separately.

    ``pattern`` is the file's own; pieces with characters of little-used blocks
    go through the library's normaliser and splitter.
    """

    def __init__(self, merges: MergeList, pattern: str, lower: bool) -> None:
        self.merges, self.lower = merges, lower
        self.find = regex.compile(pattern).findall
        self._library = None

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(json.dumps(self.merges.spec))
        return self._library

    def words(self, piece: str) -> list[str]:
        """Words of a piece without special strings, in byte letters."""
        if EXOTIC.search(piece):
            if self.library.normalizer is not None:
                piece = self.library.normalizer.normalize_str(piece)
            return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(piece)]
        return [letters_of(w) for w in self.find(piece.lower() if self.lower else piece)]

    def parts(self, piece: str) -> list[tuple[bool, str]]:
        """(is special, string) parts in order."""
        pattern = self.merges.special_pattern
        if pattern is None or not pattern.search(piece):
            return [(False, piece)]
        return [(x in self.merges.special, x) for x in pattern.split(piece) if x]


#: The split patterns of the two public vocabularies.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

ODD_SPACE = re.compile("[\x1c-\x1f]")
SPACES_MEET = re.compile(r" (?=\s|$)|^ ")


def spaced_pieces(text: str) -> tuple[str, list[str]]:
    """First piece, and the later ones without the space in front of each.

    Every space before a character that is no white space starts a new word of
    ``BYTE_PATTERN``, so the pieces can be tokenized on their own.  A later
    piece may hold spaces where several meet.
    """
    parts = text.split(" ")
    if not SPACES_MEET.search(text):
        return parts[0], parts[1:]
    out = [parts[0]]
    for p in parts[1:]:
        if not p or p[0].isspace():
            out[-1] += " " + p
        elif len(out) == 1 and not out[0]:
            out.append(p)
        else:
            out.append(p)
    return out[0], out[1:]
