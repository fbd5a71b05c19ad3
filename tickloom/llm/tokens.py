"""Token ids of whole texts by public vocabularies.

Both vocabularies cut a text at white space before anything else, so that the ids of a text
are those of its pieces in order. A Python worker keeps the ids of pieces it has met.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

from tickloom.llm.shared import worker_state

#: Pieces a worker keeps; the store is emptied when it is full.
MOST_PIECES = 1 << 19
PUNCTUATION = ".,!?;:#$%&*|-"
DOTTED_I = "İ"


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file of this installation."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as itself where it prints, else as the next letter from U+0100."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printing]
    return {**{b: chr(b) for b in printing}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class WordPieces(dict):
    """Piece without white space -> little-endian unsigned 32-bit ids, for a lower-casing word-end BPE."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MOST_PIECES:
            self.clear()
        ids = self[piece] = b"".join(i.to_bytes(4, "little") for i in self._ids(piece))
        return ids

    def _ids(self, piece: str) -> list[int]:
        # A run of Latin letters, then one of plain signs: two words of the vocabulary, which
        # need none of the normalizer's steps but lower case.
        word = piece.rstrip(PUNCTUATION)
        if (word.isalpha() or not word) and piece and (piece.isascii() or (max(piece) < "ɐ" and DOTTED_I not in piece)):
            parts = ["".join(map(self.letters.__getitem__, word.lower().encode())), piece[len(word) :]]
            return [t.id for part in parts if part for t in self.model.tokenize(part)]
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def of_text(self, text: str | None) -> bytes:
        if not text:
            return b""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


class BytePieces(dict):
    """Piece -> little-endian unsigned 16-bit ids of it after a space, for a byte-level BPE."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MOST_PIECES:
            self.clear()
        ids = self[piece] = self._ids(" " + piece)
        return ids

    def _ids(self, text: str) -> bytes:
        return b"".join(i.to_bytes(2, "little") for i in self.encoding.encode_ordinary(text))

    def of_text(self, text: str | None) -> bytes:
        if not text:
            return b""
        # Runs of spaces and a space at the end stick together; such texts are encoded whole.
        if "  " in text or text[-1] == " ":
            return self._ids(text)
        pieces = text.split(" ")
        return self._ids(pieces[0]) + b"".join(map(self.__getitem__, pieces[1:]))


def word_pieces(path: str) -> WordPieces:
    return worker_state(f"words {path}", lambda: WordPieces(path))


def byte_pieces(path: str) -> BytePieces:
    return worker_state(f"bytes {path}", lambda: BytePieces(path))


def cut(ids: bytes, width: int, most: int) -> Iterator[bytes]:
    """Pieces of at most ``most`` ids of ``width`` bytes; nothing for no ids."""
    for at in range(0, len(ids), most * width):
        yield ids[at : at + most * width]
