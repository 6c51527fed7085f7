"""Token ids of whole texts by a tokenizer file, with a bounded memory of words seen before.

Both vocabularies used here split a text into words that are encoded on their own, so a word needs encoding once per
worker, by the library's model. That holds for texts of ASCII and common Latin letters; any other text goes to the library
as a whole.
"""

from __future__ import annotations

import functools
import os
import re
import struct

import numpy as np

#: Characters outside these ranges send a text to the library as a whole: white space other than ASCII's, digits and
#: marks beyond ASCII, letters whose lower case has another length.
UNUSUAL = re.compile("[^\t-\r -~\xc0-\xd6\xd8-\xf6\xf8-įı-ɏ]")
#: The public byte-level split, written for the characters above.
BYTE_LEVEL = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:_|[^\s\w])+|\s+(?!\S)|\s+")
#: The split of the lower-casing vocabulary, likewise.
WORD_LEVEL = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:_|[^\s\w])+")


def byte_characters() -> dict[int, int]:
    """The public byte-level alphabet: visible Latin-1 characters stand for themselves, the other bytes for those from 256 on."""
    others = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
    return {b: 256 + i for i, b in enumerate(others)}


class Remembered(dict):
    """What ``make`` gives for a key, remembered for up to ``limit`` keys at a time."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Encoder:
    """ids of texts as little-endian bytes, ``width`` bytes an id.

    A word is encoded once, and so is all that stands between two blanks: in the byte-level split a blank before a character that is no white space always starts a
    word. Texts with several blanks in a row or white space at their end are split as a whole, as white space is put together there.
    """

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.letter = "H" if self.width == 2 else "I"
        # Lower-casing tokenizers drop white space too: there words are what white space separates.
        self.by_space = self.tokenizer.encode("A B", add_special_tokens=False).ids == self.tokenizer.encode("a\nb", add_special_tokens=False).ids
        self.split = WORD_LEVEL.findall if self.by_space else BYTE_LEVEL.findall
        self.model, self.alphabet = self.tokenizer.model, byte_characters()
        self.blank = chr(self.alphabet[32])
        self.words = Remembered(self.word, limit)
        # Pieces are looked up most, and each holds a few words, so more of them are remembered.
        self.pieces = Remembered(self.piece, 2 * limit)
        self.after_blank = Remembered(lambda piece: self.piece(" " + piece), 2 * limit)

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.letter}", *ids)

    def word(self, word: str) -> bytes:
        """ids of one word of the split, by the library's model."""
        if word.isascii() and word.isprintable() and " " not in word[1:]:
            shown = self.blank + word[1:] if word[0] == " " else word
        else:
            shown = word.encode().decode("latin-1").translate(self.alphabet)
        return self.packed([t.id for t in self.model.tokenize(shown)])

    def piece(self, piece: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.split(piece)))

    def text(self, text: str) -> bytes:
        if not text:
            return b""
        if UNUSUAL.search(text):
            return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if self.by_space:
            return b"".join(map(self.pieces.__getitem__, text.lower().split()))
        if "  " in text or text[-1].isspace():
            return self.piece(text)
        first, *others = text.split(" ")
        return self.pieces[first] + b"".join(map(self.after_blank.__getitem__, others))

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self.text(t) for t in texts]


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs one worker per core
    return Encoder(path)
