"""Token ids of whole texts with the ``tokenizers`` library, repeated words encoded once per worker.

A vocabulary of this kind (``Split`` on a pattern that drops white space, word-end suffix, no state between words) encodes a
text as the concatenation of its blank-separated pieces, so pieces are kept in a bounded table.  A new piece that is one Latin
letter run, with or without ASCII marks after it, goes straight to the library's model; every other piece goes through the
whole library tokenizer.  Special strings that the vocabulary would find inside a text hold no blanks, so they are found as before.
"""

from __future__ import annotations

import os
import string
from array import array
from collections.abc import Callable

KEPT_PIECES = 500_000
PIECE_CHARS = 48
MARKS = string.punctuation

_OPEN: dict[str, Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


class Pieces(dict):
    """Ids of pieces, at most ``kept`` of them; a full table becomes the older one, so that pieces in use survive."""

    def __init__(self, ids_of: Callable[[str], bytes], kept: int) -> None:
        super().__init__()
        self.ids_of, self.kept, self.older = ids_of, kept // 2, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.ids_of(piece) if piece else b""
        if len(piece) <= PIECE_CHARS:
            if len(self) >= self.kept:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, kept: int = KEPT_PIECES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.pieces = Pieces(self._piece, kept)
        self.runs: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}

    def _library(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _run(self, word: str) -> bytes:
        got = self.runs.get(word)
        if got is None:
            if len(self.runs) >= KEPT_PIECES:
                self.runs.clear()
            # ASCII letters are their own byte-level letters
            spelt = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            got = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
            self.runs[word] = got
        return got

    def _piece(self, piece: str) -> bytes:
        core = piece.rstrip(MARKS)
        if not core.isalpha() or not core.isascii() and max(core) >= "\u0100":
            return self._library(piece)
        if len(core) == len(piece):
            return self._run(core.lower())
        tail = piece[len(core):]
        ids = self.tails.get(tail)
        if ids is None:
            ids = self._library(tail)
            if len(self.tails) < KEPT_PIECES:
                self.tails[tail] = ids
        return self._run(core.lower()) + ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" ")))


def encoder(path: str, kept: int = KEPT_PIECES) -> Encoder:
    """One encoder per worker process and vocabulary, with a table of at most ``kept`` pieces."""
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    _OPEN[path].pieces.kept = kept // 2
    return _OPEN[path]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)
