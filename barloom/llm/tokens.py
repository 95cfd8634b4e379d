"""Token ids of whole texts by a public tokenizer, with bounded caches of pieces and words.

The vocabulary's own splitting never looks across white space (its pattern has no match that holds any, and
composition does not cross a space), so a text's ids are those of its space-separated pieces, one after another. A
piece of plain Latin letters, digits and ASCII signs is split here by the vocabulary's pattern and its words go to the
tokenizer's model; any other piece goes through the whole tokenizer.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator

CACHE_ENTRIES = 500_000
LONG_PIECE = 64
VOCABULARY = "word_bpe_49k.json"
#: The vocabulary's pattern over lower-case plain text.
PLAIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
PLAIN = re.compile(r"[!-;=-~À-ÖØ-Þß-öø-ÿ]*")  # no white space, no '<' (special tokens begin with it)
_encoders: dict[tuple[str, int], PieceEncoder] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


BYTE_LETTERS = byte_letters()
PLAIN_LETTERS = {c: "".join(BYTE_LETTERS[b] for b in chr(c).encode()) for c in range(128, 256)}


def pieces_of(text: str) -> list[str]:
    if "\n" in text or "\t" in text or "\r" in text:
        text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
    return text.split(" ")


class Words(dict):
    """Lower-case plain word -> id bytes."""

    def __init__(self, model, entries: int):
        super().__init__()
        self.tokenize, self.entries = model.tokenize, entries

    def __missing__(self, word: str) -> bytes:
        letters = word if word.isascii() else word.translate(PLAIN_LETTERS)
        found = array("I", [t.id for t in self.tokenize(letters)]).tobytes()
        if len(word) < LONG_PIECE:
            if len(self) >= self.entries:
                self.clear()
            self[word] = found
        return found


class PieceEncoder(dict):
    """Space-separated piece -> ids as little-endian unsigned 32-bit bytes; encode() takes whole texts."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.entries = entries
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words = Words(self.tokenizer.model, entries)

    def __missing__(self, piece: str) -> bytes:
        if PLAIN.fullmatch(piece):
            words = PLAIN_WORD.findall(piece.lower())
            found = b"".join(map(self.words.__getitem__, words))
        else:
            found = array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        if len(piece) < LONG_PIECE:
            if len(self) >= self.entries:
                self.clear()
            self[piece] = found
        return found

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, pieces_of(text or "")))


def encoder(path: str, entries: int = CACHE_ENTRIES) -> PieceEncoder:
    """One encoder for each worker process, so that its caches outlive a task."""
    if (path, entries) not in _encoders:
        _encoders[path, entries] = PieceEncoder(path, entries)
    return _encoders[path, entries]


def encode_all(path: str, texts: Iterable[str | None], end_id: int, entries: int = CACHE_ENTRIES) -> Iterator[bytes]:
    one, end = encoder(path, entries), array("I", [end_id]).tobytes()
    for text in texts:
        yield one.encode(text) + end
