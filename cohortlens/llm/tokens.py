"""Token ids of whole texts by the tokenizers library, with the ids of frequent words remembered per worker."""

from __future__ import annotations

import gc
import os
import re
import struct
import unicodedata

import numpy as np

#: A text may be cut at a single blank between two signs that aren't white: no pre-token spans it.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Latin letters (but for the one that lower-cases to two signs), then plain punctuation: two pre-tokens in every vocabulary used here.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([.,;:!?#$%&*|]*)").fullmatch
REMEMBERED = 320_000


class _Irregular(Exception):
    """White space beside the blank at which a text was cut."""


class _Pieces(dict):
    """Bytes of the ids of a piece between two blanks; the first pieces seen, which hold the frequent ones, are kept."""

    def __init__(self, encoder: Encoder, led: bool):
        super().__init__()
        self.encoder, self.led = encoder, led

    def __missing__(self, piece: str) -> bytes:
        encoder, plain = self.encoder, _PLAIN(piece)
        if plain and (piece.isascii() or unicodedata.is_normalized("NFC", piece)):
            word, rest = plain.groups()
            ids = encoder.model(word.lower() if encoder.lowers else " " + word if self.led else word)
            if rest:
                ids += encoder.model(rest)
        elif not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Irregular
        else:
            lines = piece.split("\n")
            if len(lines) > 1 and all(x and not any(map(str.isspace, x)) for x in lines):
                first = encoder.first
                return encoder.line_end.join([self[lines[0]], *[first[x] for x in lines[1:]]])
            ids = encoder.slow(" " + piece if self.led else piece)
        if len(self) < REMEMBERED:
            self[piece] = ids
        return ids


class _Signs(dict):
    """What byte-level vocabularies write for a code point, for str.translate."""

    def __init__(self, levels):
        super().__init__()
        self.levels = levels

    def __missing__(self, code: int) -> str:
        self[code] = sign = self.levels.pre_tokenize_str(chr(code))[0][0]
        return sign


class Encoder:
    """encode(text): the ids as bytes of self.dtype. The same ids as Tokenizer.encode gives for the whole text.

    A text that holds the string of a special token goes through the library whole. For words of plain letters only the
    model of the tokenizer is called, which finds the merges; everything else goes through the whole tokenizer, piece by piece.
    """

    def __init__(self, vocab: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        if "/" not in vocab:
            import public_tokenizers

            vocab = public_tokenizers.path(vocab)
        self.tok = Tokenizer.from_file(vocab)
        #: Strings that the library reads as one special token, wherever they stand in a text.
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.size = self.tok.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.lowers = self.tok.normalizer is not None
        self._letter = "H" if self.dtype.itemsize == 2 else "I"
        self._signs = _Signs(pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False))
        self._words: dict[str, bytes] = {}
        self._tokenize = self.tok.model.tokenize
        self.inner, self.first = _Pieces(self, True), _Pieces(self, False)
        self.line_end = self.slow("\n")

    def slow(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def model(self, text: str) -> bytes:
        """Ids of one pre-token."""
        known = self._words.get(text)
        if known is None:
            ids = [t.id for t in self._tokenize(text.translate(self._signs))]
            known = struct.pack(f"<{len(ids)}{self._letter}", *ids)
            if len(self._words) < REMEMBERED:
                self._words[text] = known
        return known

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(x in text for x in self.special):
            return self.slow(text)
        pieces = text.split(" ")
        try:
            return b"".join([self.first[pieces[0]], *map(self.inner.__getitem__, pieces[1:])])
        except _Irregular:
            pieces = _CUT.split(text)
            led = [" " + p for p in pieces[1:]]
            return b"".join([self.slow(pieces[0]), *[self.slow(p) if any(map(str.isspace, p[1:])) else self.inner[p[1:]] for p in led]])

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode(text), self.dtype)


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocab: str) -> Encoder:
    """One per worker process and vocabulary."""
    if vocab not in _ENCODERS:
        _ENCODERS[vocab] = Encoder(vocab)
    return _ENCODERS[vocab]


def forget() -> None:
    """Gives back the memory of a worker's encoders: for steps that come after the last token."""
    if _ENCODERS:
        _ENCODERS.clear()
        gc.collect()  # encoders and their pieces refer to each other
