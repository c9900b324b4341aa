"""Token ids of whole texts, by the tokenizers library, each distinct word encoded once.

Both tokenizers first cut a text into words by an expression that their files
state. Where a text has only characters on which Python's ``re`` and the
library's expressions agree (printable ASCII, composed Latin letters, common
punctuation), Arrow cuts it at spaces, ``re`` does the rest of that cut on the distinct
pieces, and the library's model encodes each distinct word; a bounded cache in each Python worker keeps the ids. A text with any other
character is cut only before spaces that surely start a word, and a piece that
isn't plain goes through the whole of the library. A tokenizer whose file states
other expressions is used as it is, text by text.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE = 250_000  # words in each of the cache's two generations
SLICE = 1 << 22  # bytes of texts whose ids are put together at once
_LOOSE = re.compile(r" (?=\s|\Z)")
_CUT = re.compile(r"(?= \S)")
#: Letters that composing leaves as they are and that have a lower case of their own.
_LETTERS = "A-Za-zÀ-ÖØ-öø-į"
_PLAIN = re.compile(f"[{_LETTERS}]+")
#: Neither letters, numbers nor white space, and left as they are by composing: Latin-1 signs, dashes, quotes, the euro.
_SIGNS = "\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7‐-‧€"
_SIMPLE = re.compile(f"[\t\n\r\x20-\x7e{_LETTERS}{_SIGNS}]*")

# The expressions in the two tokenizers' files, and how they read on simple texts.
_SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+")
_BYTE_LEVEL = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")


def _byte_characters() -> list[str]:
    """Byte-level tokenizers write a byte as its Latin-1 character if that can be seen, else as one from U+0100 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in seen]
    return [chr(b if b in seen else 256 + hidden.index(b)) for b in range(256)]


_CHARACTERS = _byte_characters()
_SEEN = dict(enumerate(_CHARACTERS[:128]))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces(dict):
    """Ids by piece, encoded when first asked for; what two generations of CACHE pieces don't hold is encoded anew."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(piece)
        self[piece] = ids
        return ids

    def turn(self) -> None:
        if len(self) > CACHE:
            self.old = dict(self)
            self.clear()


def _kind(description: dict) -> str:
    """Which of the two known ways of cutting the tokenizer's file states: "words", "bytes", or "" for any other."""
    steps = description.get("normalizer") or {}
    names = [s["type"] for s in steps.get("normalizers", [steps])] if steps else []
    cut = description.get("pre_tokenizer") or {}
    cuts = cut.get("pretokenizers", [cut])
    levels = [c for c in cuts if c.get("type") == "ByteLevel" and not c.get("add_prefix_space")]
    if names == ["NFC", "Replace", "Lowercase"] and len(cuts) == 2 and len(levels) == 1 and not levels[0].get("use_regex"):
        split = cuts[0]
        if split.get("pattern") == {"Regex": _SPLIT_PATTERN} and split.get("invert") and split.get("behavior") == "Removed":
            return "words"
    if not names and len(cuts) == 1 and len(levels) == 1 and levels[0].get("use_regex", True):
        return "bytes"
    return ""


class PieceEncoder:
    """Ids of whole texts, as little-endian unsigned 32-bit integers.

    Two kinds of tokenizers are known: "words" lower-cases and drops white space,
    in "bytes" a word has the space before it. Simple texts are cut at spaces and
    their distinct pieces looked up a slice at a time, by Arrow and numpy.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.kind = _kind(json.loads(self.tok.to_str()))
        special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.words = Pieces(self._word_ids)  # as the tokenizer cuts them
        # what stands between two spaces of a text: cut further by the tokenizer's expression, or by the library itself
        self.pieces = self.words if self.kind == "words" else Pieces(self._spaced_ids)
        self.others = Pieces(self._other_ids)

    def _ids(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _model_ids(self, word: str) -> bytes:
        """Ids of one of the tokenizer's own words, which its model reads in the characters of its bytes."""
        if not word.isascii():
            word = "".join(map(_CHARACTERS.__getitem__, word.encode()))
        elif not word.isalpha():
            word = word.translate(_SEEN)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _word_ids(self, word: str) -> bytes:
        if word.isalpha() and word.isascii():
            return self._model_ids(word)
        found = (_SPLIT if self.kind == "words" else _BYTE_LEVEL).findall(word)
        return self._model_ids(word) if len(found) == 1 else b"".join(map(self.words.__getitem__, found))

    def _spaced_ids(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():
            return self._model_ids(" " + piece)
        first, *rest = _BYTE_LEVEL.findall(" " + piece)
        if not rest:
            return self._model_ids(first)
        head = self.pieces[first[1:]] if len(first) > 1 else self.words[first]
        return head + b"".join(map(self.words.__getitem__, rest))

    def _other_ids(self, piece: str) -> bytes:
        if _PLAIN.fullmatch(piece):
            return self.pieces[piece.lower() if self.kind == "words" else piece]
        return self._ids(piece if self.kind == "words" else " " + piece)

    def text_ids(self, text: str) -> bytes:
        """Ids of one text of any kind."""
        if not self.kind or self.special and self.special.search(text):
            return self._ids(text)
        if _SIMPLE.fullmatch(text):
            found = _SPLIT.findall(text.lower()) if self.kind == "words" else _BYTE_LEVEL.findall(text)
            return b"".join(map(self.words.__getitem__, found))
        if self.kind == "words":
            return b"".join(map(self.others.__getitem__, filter(None, text.replace("\n", " ").split(" "))))
        if _LOOSE.search(text):
            head, *rest = (p if not i else p[1:] for i, p in enumerate(_CUT.split(text)))
        else:
            head, *rest = text.split(" ")
        return self._ids(head) + b"".join(map(self.others.__getitem__, rest))

    def _cuts_at_spaces(self, text: str) -> bool:
        if not self.kind or not _SIMPLE.fullmatch(text) or self.special and self.special.search(text):
            return False
        return self.kind == "words" or not _LOOSE.search(text)

    def _slice(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = column.to_pylist()
        alone = [i for i, t in enumerate(texts) if t and not self._cuts_at_spaces(t)]
        table = [self.text_ids(texts[i]) for i in alone]
        if alone:
            plain = np.ones(len(texts), dtype=bool)
            plain[alone] = False
            column = pc.if_else(pa.array(plain), column, "")
        column = pc.fill_null(column, "")
        lists = pc.ascii_split_whitespace(pc.utf8_lower(column)) if self.kind == "words" else pc.split_pattern(column, " ")
        ends = lists.offsets.to_numpy()[1:].astype(np.int64) - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        which = coded.indices.to_numpy().astype(np.int64) + len(table)
        table += map(self.pieces.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False))
        begins = np.concatenate([[0], ends[:-1]])
        if self.kind != "words":  # each text has a first piece, which has no space before it
            some = np.flatnonzero(ends > begins)
            heads = [t.partition(" ")[0] if t else "" for t in column.to_pylist()]
            which[begins[some]] = len(table) + np.arange(len(some))
            table += (self.words[heads[i]] if heads[i] else b"" for i in some.tolist())
        if alone:  # in place of whatever an empty text gave
            empty = (ends - begins)[alone]
            drop = begins[alone][empty > 0]
            which = np.insert(np.delete(which, drop), begins[alone] - np.searchsorted(drop, begins[alone]), np.arange(len(alone)))
            counts = ends - begins
            counts[alone] = 1
            ends = np.cumsum(counts)
        size = np.fromiter(map(len, table), dtype=np.int64, count=len(table)) // 4
        first = np.cumsum(size) - size
        taken = size[which]
        upto = np.cumsum(taken)
        at = np.repeat(first[which] - (upto - taken), taken) + np.arange(int(taken.sum()))
        ids = np.frombuffer(b"".join(table), dtype="<u4")[at]
        return ids, np.concatenate([[0], upto])[ends]

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, ends) of a slice of the texts at a time: where each text's ids end among the slice's. A null text has none."""
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto, at = np.cumsum(size), 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE, side="right")))
            yield self._slice(texts.slice(at, to - at))
            at = to
            for held in (self.words, self.pieces, self.others):
                held.turn()


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """The worker's encoder; tasks that follow each other in a worker share its cache."""
    return PieceEncoder(path)
