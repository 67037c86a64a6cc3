"""Exact and fast ids of a word-level BPE tokenizer file.

The tokenizer lower-cases, splits into words, digits and runs of signs, and
merges inside each of them; so a text's ids are the ids of its pieces.  Pieces
repeat, hence their ids are kept in a bounded table.  Texts outside the plain
range (where Unicode rules of two libraries could differ, or that hold special
tokens) go to the tokenizer as they are.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np

_LETTER = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
# the pieces of the tokenizer file's own split pattern, for the plain range
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+")
# İ lower-cases to two characters; \x1c-\x1f are white space for Python alone
_ODD = re.compile("[\x1c-\x1fİɐ-\U0010ffff]")
_ODD_ASCII = re.compile("[\x1c-\x1f]")


class WordEncoder:
    """``ids(texts)``: one little-endian id array per text, no special tokens
    added.  ``max_pieces`` bounds the table of known pieces; what is met first
    is frequent and stays, later pieces are known for one call only."""

    def __init__(self, tokenizer_json: str, max_pieces: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        vocab = json.loads(tokenizer_json)["model"]["vocab"]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.dtype = np.dtype("<u2" if len(self.ends) <= 1 << 16 else "<u4")
        self.max_pieces = max_pieces
        self.known: dict[str, bytes] = {}

    def _learn(self, pieces: list[str], into: dict[str, bytes]) -> None:
        """Ids of new pieces from one call: each piece is a word of its own
        when spaces stand around it, and its last id is one that ends a word."""
        for at in range(0, len(pieces), 5000):
            part = pieces[at:at + 5000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(part):
                raw, width = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
                a = 0
                for p, b in zip(part, (cut * width).tolist()):
                    into[p] = raw[a:b]
                    a = b
            else:
                for p in part:
                    into[p] = self._plain(p).tobytes()

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [[] if not t else _PIECE.findall(t.lower()) if _is_plain(t) else None for t in texts]
        new = set().union(*filter(None, split)).difference(self.known)
        if len(self.known) + len(new) <= self.max_pieces:
            self._learn(sorted(new), self.known)
            get = self.known.__getitem__
        else:
            late: dict[str, bytes] = {}
            self._learn(sorted(new), late)
            get = lambda p, a=self.known, b=late: a.get(p) or b[p]
        return [self._plain(t) if pieces is None else
                np.frombuffer(b"".join(map(get, pieces)), self.dtype)
                for t, pieces in zip(texts, split)]


def _is_plain(text: str) -> bool:
    return "<|" not in text and not (_ODD_ASCII if text.isascii() else _ODD).search(text)


_OPEN: dict[int, WordEncoder] = {}


def encoder(tokenizer_json: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file; it outlives a task."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = WordEncoder(tokenizer_json)
    return _OPEN[key]
