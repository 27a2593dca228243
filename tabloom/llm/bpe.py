"""Byte-level BPE through a cache of words and pre-tokens.

The vocabulary's pre-tokenizer cuts a text into pieces that are encoded
independently, and a piece never crosses a single space between two other
characters.  A worker therefore splits the text at such spaces and looks the
words up; a new word is cut into pieces by one regular expression, and only a
new piece goes through the tokenizers library.  Texts with characters outside
a plain range, where two regular-expression engines might class a code point
differently, or with a special string take the library's own path as a whole.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import regex

# fixed values: the byte-level pre-tokenizer's pattern and its special string
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"

_cut = regex.compile(PATTERN, regex.V0).findall
# Latin, Greek and Cyrillic letters and common punctuation are classed alike everywhere
_odd = regex.compile("[^\\x00-\\x1b\\x20-\\x7e\\u00a0-\\u024f\\u0391-\\u03a1\\u03a3-\\u03ce\\u0400-\\u0481\\u2010-\\u2027\\u2030-\\u205e\\u20ac]").search

_split = re.compile(r"(?<=\S) (?=\S)").split

TOGETHER = 1 << 20      # characters of texts that are encoded together


def rank_encoder(path: str):
    """Encoder of text without special strings from the same vocabulary as ranks; faster on short pieces."""
    import base64

    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def rough_words(text: str) -> list[str]:
    """A plain text cut at its spaces and before its line feeds; the first part follows neither."""
    return text.replace("\n", " \n").split(" ")


class _Loose(Exception):
    """A space beside other white space: the text needs the careful split."""


class Pieces(dict):
    """Cache from a word (that follows a space, or begins with its line feed) to ``value(ids)``.

    ``join`` puts the values of a word's pieces together.  Up to ``limit``
    values are kept besides the given ``first`` (piece -> value); frequent
    words are met early, so those that come when it is full are only encoded.
    ``ranks`` names the file of the same vocabulary as ranks, for new pieces.
    """

    def __init__(self, path: str, value, join, first: dict | None = None, limit: int = 300_000, ranks: str | None = None):
        from tokenizers import Tokenizer
        super().__init__({p[1:]: v for p, v in (first or {}).items() if p[0] == " "})
        self.bare = {p: v for p, v in (first or {}).items() if p[0] != " "}
        self.value, self.join, self.limit = value, join, limit + len(first or {})
        self.library = Tokenizer.from_file(path)
        self.ranks = rank_encoder(ranks) if ranks else None

    def __missing__(self, word: str):
        if word[:1] == "\n" and len(word) > 1 and not word[1].isspace():
            pieces = _cut(word)         # a line's first word follows no space
        elif not word or word[0].isspace() or word[-1].isspace():
            raise _Loose
        else:
            pieces = _cut(" " + word)
        v = self.one(pieces[0]) if len(pieces) == 1 else self.join([self.piece(p) for p in pieces])
        if len(self) < self.limit:
            self[word] = v
        return v

    def piece(self, p: str):
        if p[0] == " " and len(p) > 1:
            return self[p[1:]] if not p[1].isspace() else self.one(p)
        v = self.bare.get(p)
        if v is None:
            v = self.one(p)
            if len(self.bare) < self.limit:
                self.bare[p] = v
        return v

    def one(self, p: str):
        """The value of a single piece."""
        return self.value(self.ranks(p)) if self.ranks else self.encode(p)

    def encode(self, p: str):
        """The value of any text by the tokenizers library."""
        return self.value(self.library.encode(p, add_special_tokens=False).ids)

    def of(self, text: str):
        """The joined value of a whole text."""
        if SPECIAL in text or _odd(text):
            return self.encode(text)
        words = rough_words(text)
        if not words[0] or words[0][-1].isspace():
            return self.careful(text)
        try:
            rest = list(map(self.__getitem__, words[1:]))
        except _Loose:
            return self.careful(text)
        return self.join([*map(self.piece, _cut(words[0])), *rest])

    def careful(self, text: str):
        """The same with a split only at spaces that stand alone."""
        out = []
        for i, word in enumerate(_split(text)):
            if i and not any(map(str.isspace, word)):
                out.append(self[word])
            else:
                out += map(self.piece, _cut(" " + word if i else word))
        return self.join(out)


class _Rows(dict):
    """Row of each word, as they are met; ``new`` lists those met since it was emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        own = word.removeprefix("\n")
        if not own or own != own.strip():
            raise _Loose
        self[word] = row = len(self)
        self.new.append(word)
        return row


class Encoder:
    """Ids of whole texts, two bytes each (little-endian); the vocabulary has fewer than 65536.

    Texts become rows of words, and the ids of all rows are gathered at once.
    Words that are new are encoded together, as one text: each follows a single
    space or begins with its line feed, and holds neither besides, so an id
    that begins with one of them begins a word.  Up to ``limit`` words are
    remembered.  Texts that :class:`Pieces` would not cut at every space take
    its way.
    """

    def __init__(self, path: str, limit: int = 300_000, ranks: str | None = None):
        self.pieces = Pieces(path, lambda ids: struct.pack(f"<{len(ids)}H", *ids), b"".join, limit=limit, ranks=ranks)
        self.rows, self.limit = _Rows(), limit
        self.ids, self.bounds = np.zeros(0, "<u2"), np.zeros(1, np.int64)     # a row's ids lie between two bounds
        vocabulary = self.pieces.library.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t[0] in "\u0120\u010a"]] = True    # space, line feed

    def of(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        out: list[bytes] = []
        part: list[str] = []
        size = 0
        for i, text in enumerate(texts):
            part.append(text)
            size += len(text)
            if size >= TOGETHER or i + 1 == len(texts):
                out += self.together(part)
                part, size = [], 0
        return out

    def together(self, texts: list[str]) -> list[bytes]:
        """The ids of a few texts: those that precede a text's rows, and those of its rows."""
        heads, rows = [], []
        for text in texts:
            words = [""] if SPECIAL in text or _odd(text) else rough_words(text)
            own = np.zeros(0, np.int64)
            if not words[0] or words[0][-1].isspace():
                head = self.pieces.of(text)
            else:
                try:
                    own = np.fromiter(map(self.rows.__getitem__, words[1:]), np.int64, len(words) - 1)
                    head = self.pieces.join(map(self.pieces.piece, _cut(words[0])))
                except _Loose:
                    head = self.pieces.careful(text)
            heads.append(head)
            rows.append(own)
        self.learn()
        row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        n = self.bounds[row + 1] - self.bounds[row]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
        flat = self.ids[np.repeat(self.bounds[row] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        at = (2 * ends[np.cumsum([0] + [len(r) for r in rows])]).tolist()
        self.forget()
        return [head + flat[s:e] for head, s, e in zip(heads, at[:-1], at[1:])]

    def learn(self) -> None:
        """Ids of the new words, as further rows."""
        new = self.rows.new
        if not new:
            return
        whole = "".join([w if w[0] == "\n" else " " + w for w in new])
        ids = np.array(self.pieces.ranks(whole) if self.pieces.ranks else self.pieces.library.encode(whole, add_special_tokens=False).ids)
        first = np.flatnonzero(self.begins[ids])
        if len(first) != len(new):
            raise ValueError(f"{len(new)} words were encoded as {len(first)}")
        self.bounds = np.concatenate([self.bounds, len(self.ids) + np.append(first[1:], len(ids))])
        self.ids = np.concatenate([self.ids, ids.astype("<u2")])

    def forget(self) -> None:
        """Drops the words met last, those beyond the limit."""
        over = len(self.rows) - self.limit
        for word in self.rows.new[-over:] if over > 0 else []:
            del self.rows[word]
        self.rows.new = []
        self.bounds = self.bounds[:self.limit + 1]
        self.ids = self.ids[:self.bounds[-1]]


def pieces_of(text: str) -> list[str]:
    """Pre-tokens of a text (none for texts that need the library's own path)."""
    return [] if SPECIAL in text or _odd(text) else _cut(text)
