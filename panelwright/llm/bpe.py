"""Exact, cached encoding with files of the tokenizers library.

Neither vocabulary merges across the white space between two words, so a text can be cut there, and
each distinct chunk needs the library only once. Chunks are cut only where that is certain to change
nothing; what is left in one chunk the library sees whole. A special token that is written out in a text
is one id, as by the library's defaults; it holds no white space, so that no cut divides it.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa

from panelwright.llm.common import PieceCache, Pieces

_SINGLE_SPACE = re.compile(r"(?<=\S)(?= \S)")
#: White space in Python's sense; the first four are none to the library.
_SPACE = r"\x1c-\x1f\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: ASCII punctuation that may follow a word; no apostrophe, which starts contractions.
_TAIL = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"


def _byte_characters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, the
    others, in order, for the characters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTE_CHARACTERS = _byte_characters()


#: Bytes of text encoded at once, and pieces kept: a word met again costs a lookup, a new one the library.
ENCODE_BYTES, KEPT_PIECES = 8_000_000, 700_000


class ChunkEncoder:
    """16-bit ids of whole texts (vocabularies below 65,536 ids)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() >= 1 << 16:
            raise ValueError("The vocabulary needs more than 16 bits an id")
        self.cache = PieceCache(self._encode, np.uint16, KEPT_PIECES)
        #: Ids of the punctuation seen after words.
        self.tails: dict[str, bytes] = {}
        #: Whether white space is dropped between words, or belongs to the word after it.
        self.drops_space = type(self.tokenizer.pre_tokenizer).__name__ != "ByteLevel"

    def _literal(self, key: str) -> str:
        if self.drops_space or key.startswith("\n"):
            return key
        return key[1:] if key.startswith("\r") else f" {key}"

    def _library(self, keys: list[str]) -> list[bytes]:
        literal = [self._literal(k) for k in keys]
        found = self.tokenizer.encode_batch_fast(literal, add_special_tokens=False)
        return [array("H", x.ids).tobytes() for x in found]

    def _encode(self, keys: list[str]) -> list[bytes]:
        """A word of Latin letters, with or without punctuation after it, is known to be two pieces to
        the library's pre-tokenizer and goes to its merge model directly; other keys go through all."""
        merge, space = self.tokenizer.model.tokenize, "" if self.drops_space else _BYTE_CHARACTERS[32]
        out: list[bytes | None] = [None] * len(keys)
        for i, key in enumerate(keys):
            word = key.rstrip(_TAIL)
            tail = self.tails.get(key[len(word) :])
            if tail is None:
                self.tails[key[len(word) :]] = tail = self._library([("" if self.drops_space else "\r") + key[len(word) :]])[0]
            if self.drops_space:
                word = word.lower()
            if word.isalpha() and (word.isascii() or max(word) < "\u0250"):
                if not word.isascii():
                    word = word.encode().decode("latin-1").translate(_BYTE_CHARACTERS)
                out[i] = array("H", [x.id for x in merge(space + word)]).tobytes() + tail
        others = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(others, self._library([keys[i] for i in others]), strict=True):
            out[i] = x
        return out

    def _words(self, texts: pa.Array) -> pa.ListArray:
        import pyarrow.compute as pc

        odd = pc.match_substring_regex(texts, r"[\x1c-\x1f]")
        return _either(odd, texts, lambda t: [t], pc.utf8_split_whitespace)

    def _spaced(self, texts: pa.Array) -> pa.ListArray:
        """A key means " key"; one with a leading CR the rest of it, one with a leading newline itself.

        Without adjacent white space every space and newline starts a chunk; else only single spaces do.
        """
        import pyarrow.compute as pc

        def cut(some: pa.Array) -> pa.ListArray:
            lines = pc.replace_substring(some, "\n", " \n")
            return pc.split_pattern(pc.binary_join_element_wise("\r", lines, ""), " ")

        adjacent = pc.match_substring_regex(texts, f"[{_SPACE}][{_SPACE}]")
        return _either(adjacent, texts, lambda t: ["\r" + x for x in _SINGLE_SPACE.split(t)], cut)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in one array, and the bounds of each text in it."""
        lists = self._words(texts) if self.drops_space else self._spaced(texts)
        return self.cache.gather(Pieces(lists))


def _either(odd: pa.Array, texts: pa.Array, one, many) -> pa.ListArray:
    """``many`` on the whole array; ``one`` on each of the texts marked ``odd`` instead."""
    lists = many(texts)
    if not odd.true_count:
        return lists
    return pa.array([one(t) if o else x for t, x, o in zip(texts.to_pylist(), lists.to_pylist(), odd.to_pylist(), strict=True)], pa.list_(pa.string()))


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker process and file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def public_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
