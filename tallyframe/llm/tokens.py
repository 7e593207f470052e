"""Token ids of whole texts, by a public tokenizer file, for tasks that run inside Spark.

These tokenizers never look across the start of white space after another sign, so a text's ids are
those of its parts, cut at line feeds and before single spaces. Parts repeat far more often than
texts, so each worker remembers the ids of short parts. A text with a longer run of white space is
cut only after signs that are surely not white space.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

#: A common word with common signs after it: letters that every normal form and lower-casing treats alike.
_WORD = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@]*)")
_SAFE_CUT = re.compile("(?<=[!-~¡-ᙿ])(?= )")
_WHITE = [chr(c) for c in (*range(9, 14), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: White space beside a space or a line feed.
_RUNS = ["  ", *[f"{a}{b}" for w in _WHITE for a, b in ((w, " "), (" ", w))], *[f"{a}{b}" for w in _WHITE for a, b in {(w, "\n"), ("\n", w)}]]
_ASCII_RUNS = [x for x in _RUNS if x.isascii()]
#: Parts, and words, remembered by one worker; further ones are encoded again whenever they come.
REMEMBERED = 800_000
#: Longer parts are not remembered.
LONG = 48


class Encoder(dict):
    """Ids of texts as little-endian unsigned 32-bit integers; as a mapping, ids of parts."""

    def __init__(self, file: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
        self.model = self.tokenizer.model
        self.keeps_space = file.startswith("byte_")
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.signs = {i: level.pre_tokenize_str(chr(i))[0][0] for i in (*range(0x20, 0x7F), *range(0xC0, 0x100))}
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        """Ids of one word or run of signs, straight from the tokenizer's model."""
        ids = self.words.get(word)
        if ids is None:
            ids = array("I", [t.id for t in self.model.tokenize(word.translate(self.signs))]).tobytes()
            if len(self.words) < REMEMBERED:
                self.words[word] = ids
        return ids

    def __missing__(self, part: str) -> bytes:
        if found := _WORD.fullmatch(part):
            word, signs = found.groups()
            if not self.keeps_space:
                word = word.strip(" ").lower()
            ids = self._word(word) + self._word(signs) if signs else self._word(word)
        else:
            ids = array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()
        if len(part) <= LONG and len(self) < REMEMBERED:
            self[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not self.keeps_space:
            return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))
        if "\0" in text or any(map(text.__contains__, _ASCII_RUNS if text.isascii() else _RUNS)) or text[:1] == "\n" or text[-1:] == "\n":
            return b"".join(map(self.__getitem__, _SAFE_CUT.split(text)))
        return b"".join(map(self.__getitem__, text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")))


@lru_cache(maxsize=4)
def encoder(file: str) -> Encoder:
    """One per worker process and file."""
    return Encoder(file)
