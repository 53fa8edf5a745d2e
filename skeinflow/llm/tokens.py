"""Token ids by a public tokenizer's file, with each distinct run of letters encoded once per worker."""

from __future__ import annotations

import re
from array import array

import numpy as np
import regex

from .common import CACHE_WORDS

#: What word_bpe_49k.json itself splits by (its file states this pattern, after NFC, white space to a blank, and lower case).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Words of these characters only take the short way; they are their own NFC, and Python and the library lower-case them alike.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+").fullmatch
#: Python cuts words at these, the library doesn't; texts with them are encoded whole.
ODD = re.compile("[\x1c-\x1f]").search


def byte_letters() -> list[str]:
    """The printable letter that byte-level BPE vocabularies use for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return [chr({b: b for b in own}.get(b, 256 + (rest.index(b) if b in rest else 0))) for b in range(256)]


class WordTokens(dict):
    """word -> its ids as little-endian 32-bit bytes. Exactly what the library gives, as it treats words between blanks one by one."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.pieces, self.codes = {}, {}
        self.merge = self.short_way()
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS // 2:
            self.clear()
        if PLAIN(word) and "<|" not in word:
            low = word.lower()
            if low.isalpha():
                ids = self.piece(low)
            elif low[:-1].isalpha():
                ids = self.piece(low[:-1]) + self.piece(low[-1])
            else:
                ids = b"".join(map(self.piece, PIECES.findall(low)))
        else:
            ids = self.encode(word)
        self[word] = ids
        return ids

    def short_way(self):
        """The file's merges over the bytes of PLAIN words, run by tiktoken, which is several times faster.

        Each byte has one code inside a word and another as its end (the file's </w>), so 2 x 102 codes do. That a pair is
        merged by the rank of what it makes gives the same ids, as each entry of the vocabulary encodes to itself (tested).
        """
        import tiktoken

        inside = sorted({*range(33, 127)} - {*range(65, 91)} | {0xC3} | {*range(0x9F, 0xC0)})
        letters = byte_letters()
        code = {letters[b]: bytes([i]) for i, b in enumerate(inside)}
        last = {letters[b]: bytes([128 + i]) for i, b in enumerate(inside)}
        self.table = bytes(inside.index(b) if b in inside else 0 for b in range(256))
        ranks = {}
        for token, rank in self.whole.get_vocab().items():
            body, end = (token[:-4], True) if token.endswith("</w>") and len(token) > 4 else (token, False)
            if body and all(c in code for c in body):
                ranks[b"".join(code[c] for c in body[:-1]) + (last if end else code)[body[-1]]] = rank
        self.used = ranks
        return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def piece(self, run: str) -> bytes:
        ids = self.pieces.get(run)
        if ids is None:
            if len(self.pieces) >= CACHE_WORDS // 2:
                self.pieces.clear()
            codes = run.encode().translate(self.table)
            ids = self.pieces[run] = array("I", self.merge(codes[:-1] + bytes([codes[-1] + 128]))).tobytes()
        return ids

    def forget(self) -> None:
        """Empties what is remembered of words, at the end of a task."""
        self.clear()
        self.pieces.clear()

    def encode(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def text(self, text: str) -> bytes:
        """Ids of a whole text, as bytes."""
        if ODD(text) or any(t in text for t in self.special):
            return self.encode(text)
        return b"".join(map(self.__getitem__, text.split()))


_LOADED: dict[str, WordTokens] = {}


def tokenizer(path: str) -> WordTokens:
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
