"""BPE encoding by depth-first traversal of a trie of distinct words, and decoding.

The encoding of every prefix of a word ends in one token, its state. The state of a prefix is the one vocabulary token
that is a suffix of it and that, behind the state of what precedes it, no merge would join differently. So the distinct
words go into a trie, a depth-first walk gives each node its state from the states on its path, and the encoding of a
shared prefix is worked out once for all words below it. A word's ids are read off by stepping back from its last node.

A word's last letter is another symbol than the same letter inside a word (the vocabulary marks word ends), so whole
words end in leaves of the trie.

Defined cases: a NULL text counts as empty (no ids, empty decoded text); a NULL doc_id is kept; repeated rows come back
as often; an empty table gives an empty result; columns other than the two named ones are not read. Words and documents
may be of any length. Vocabularies in which two merges give the same token, or a merge comes before its parts, are
refused, as are those with a decoder of their own.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm import tokens

WORD_END = "</w>"
END_SHIFT = 0xE000  # private letters stand for letters that end a word
TRIE_WORDS = 20_000
CACHE_ENTRIES = 400_000
CACHE_PAIRS = 1_500_000
NEVER = 1 << 40
_known: dict[str, TrieEncoder] = {}


def marked(word: str) -> str:
    """The word's symbols: byte letters, the last one shifted."""
    return word[:-1] + chr(END_SHIFT + ord(word[-1]))


class Merges:
    """The vocabulary's tokens as symbol strings, and which token may follow which."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if spec.get("decoder") is not None or model.get("end_of_word_suffix") != WORD_END:
            raise ValueError("only vocabularies with word ends and without a decoder are supported")
        own = {t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        symbols = lambda t: marked(t[: -len(WORD_END)]) if t.endswith(WORD_END) and t != WORD_END else t
        self.token = {symbols(t): i for t, i in model["vocab"].items() if t not in own}
        self.size = {i: len(s) for s, i in self.token.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = self.token[symbols(left)], self.token[symbols(right)]
            new = self.token[symbols(left + right)]
            if new in self.parts or any(self.size[x] > 1 and x not in self.parts for x in (a, b)):
                raise ValueError(f"merge {rank} repeats a token or precedes its parts")
            self.rank[a, b], self.parts[new], self.made[new] = rank, (a, b), rank
        self.longest = max(self.size.values())
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """Symbols that stand at an edge of the token while it is made: symbol, rank made, rank used up."""
        chain, used = [], NEVER
        while True:
            made = self.made.get(token, -1)
            chain.append((token, made, used))
            if made < 0:
                return chain
            token, used = self.parts[token][side], made

    def follows(self, a: int, b: int) -> bool:
        """Whether the text of a and b is encoded as these two tokens."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            known = self._follows(a, b)
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def _follows(self, a: int, b: int) -> bool:
        left = self.edge(b, 0)
        for x, x_made, x_used in self.edge(a, 1):
            for y, y_made, y_used in left:
                rank = self.rank.get((x, y))
                # of equal merges the one further left comes first: inside a before the border, the border before b
                if rank is not None and x_made < rank < x_used and y_made < rank <= y_used:
                    return False
        return True

    def stands(self, token: int) -> bool:
        """Whether the token's own text is encoded as that token."""
        known = self.whole.get(token)
        if known is None:
            parts = self.parts.get(token)
            known = parts is None or (self.stands(parts[0]) and self.stands(parts[1]) and self._joined(*parts))
            self.whole[token] = known
        return known

    def _joined(self, a: int, b: int) -> bool:
        """Whether nothing joins the border of two parts before their own merge does."""
        own = self.rank[a, b]
        for x, x_made, x_used in self.edge(a, 1):
            for y, y_made, y_used in self.edge(b, 0):
                rank = self.rank.get((x, y))
                if rank is not None and rank < own and x_made < rank < x_used and y_made < rank <= y_used:
                    return False
        return True


class TrieEncoder:
    """Whole texts -> ids. Splitting follows the vocabulary's file; encoding is the trie walk."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            self.merges = Merges(json.load(file))
        splitter = Tokenizer.from_file(path)
        self.normalise, self.split = splitter.normalizer.normalize_str, splitter.pre_tokenizer.pre_tokenize_str
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.merges.special, key=len, reverse=True))) + ")")
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {"": b""}

    def walk(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of distinct words (byte letters), prefix by prefix."""
        root: dict = {}
        for word in words:
            node = root
            for symbol in marked(word):
                node = node.setdefault(symbol, {})
        token, size, longest = self.merges.token.get, self.merges.size, self.merges.longest
        follows, stands = self.merges.follows, self.merges.stands
        states = [0]  # states[k]: last token of the path's first k symbols
        stack = [(symbol, "", node) for symbol, node in root.items()]
        while stack:
            symbol, path, node = stack.pop()
            path += symbol
            depth = len(path)
            del states[depth:]
            for start in range(max(0, depth - longest), depth):
                found = token(path[start:])
                if found is not None and stands(found) and (start == 0 or follows(states[start], found)):
                    states.append(found)
                    break
            else:
                raise ValueError(f"a symbol of {path!r} is not in the vocabulary")
            if node:
                stack.extend([(s, path, n) for s, n in node.items()])
            else:
                ids, at = [], depth
                while at:
                    ids.append(states[at])
                    at -= size[states[at]]
                ids.reverse()
                yield path[:-1] + chr(ord(symbol) - END_SHIFT), array("I", ids).tobytes()

    def split_piece(self, piece: str) -> list[str | int]:
        """Words as byte letters, special tokens as ids."""
        if tokens.PLAIN.fullmatch(piece):
            words = tokens.PLAIN_WORD.findall(piece.lower())
            return words if piece.isascii() else [w.translate(tokens.PLAIN_LETTERS) for w in words]
        out: list[str | int] = []
        for part in self.special.split(piece):
            if part in self.merges.special:
                out.append(self.merges.special[part])
            elif part:
                out += [w for w, _ in self.split(self.normalise(part)) if w]
        return out

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit bytes."""
        split = [tokens.pieces_of(t or "") for t in texts]
        known = self.pieces
        missing = {p for pieces in split for p in pieces if p not in known}
        if len(known) + len(missing) > CACHE_ENTRIES:
            self.pieces = known = {"": b""}
            missing = {p for pieces in split for p in pieces if p}
        parts = {p: self.split_piece(p) for p in missing}
        if len(self.words) > CACHE_ENTRIES:
            self.words = {}
        new = list({w for x in parts.values() for w in x if isinstance(w, str) and w not in self.words})
        for at in range(0, len(new), TRIE_WORDS):
            self.words.update(self.walk(new[at : at + TRIE_WORDS]))
        words = self.words
        for piece, found in parts.items():
            known[piece] = b"".join([words[w] if isinstance(w, str) else array("I", [w]).tobytes() for w in found])
        return [b"".join(map(known.__getitem__, pieces)) for pieces in split]

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens' texts, special ones too, parted by spaces."""
        return " ".join(map(self.merges.text.__getitem__, ids))


def encoder(path: str) -> TrieEncoder:
    if path not in _known:
        _known[path] = TrieEncoder(path)
    return _known[path]


def batches_by_size(texts: list[str | None], chars: int = 1_500_000) -> Iterator[tuple[int, int]]:
    """Runs of rows that hold about so many characters together."""
    begin = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= chars:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encode_and_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (bytes) and decoded text of every document."""
    path = path or tokens.vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raws, decoded in encoded(path, batches):
            cols = [pa.array(ids, pa.int64()), pa.array(raws, pa.binary()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, decoded string")


def encoded(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes], list[str]]]:
    one = encoder(path)
    for batch in batches:
        doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for begin, end in batches_by_size(texts):
            raws = one.encode_batch(texts[begin:end])
            yield doc_ids[begin:end], raws, [one.decode(array("I", x)) for x in raws]


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode_and_decode() with its texts digested where they are made."""
    path = path or tokens.vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raws, decoded in encoded(path, batches):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(x) // 4 for x in raws], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in raws]),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
