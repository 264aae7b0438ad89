"""Ids of a byte-level BPE vocabulary of the tokenizers library, with remembered pre-tokens.

A pre-token never spans the border between a non-space and a single space, so a
text without two spaces in a row splits at its spaces into parts that encode
alone. Each distinct part is cut into pre-tokens by the vocabulary's public
pattern and each distinct pre-token goes once through the library's model; a
memo gives the rest. Texts that hold two spaces in a row, or a special string,
go through the library whole.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

from mandatewatch.llm.common import MEMO_ENTRIES

VOCABULARY = "byte_bpe_50k.json"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself, or the next free one from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class ByteBpe:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec["pre_tokenizer"]
        if spec["normalizer"] or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or not kind["use_regex"]:
            raise ValueError("only plain byte-level vocabularies are supported")
        self.tokenize = self.library.model.tokenize
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = regex.compile(public_tokenizers.PATTERN).findall
        self.letters = byte_letters()
        self.packed = [k.to_bytes(4, "little") for k in range(self.library.get_vocab_size())]
        self.pre_tokens: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _pre_token(self, piece: str) -> bytes:
        found = self.pre_tokens.get(piece)
        if found is None:
            if piece.isascii() and piece.isprintable() and " " not in piece[1:]:
                # Printable ASCII but the space stands for itself.
                spelled = self.letters[0x20] + piece[1:] if piece[0] == " " else piece
            else:
                spelled = piece.encode().decode("latin-1").translate(self.letters)
            packed = self.packed
            found = b"".join([packed[t.id] for t in self.tokenize(spelled)])
            if len(self.pre_tokens) < MEMO_ENTRIES:
                self.pre_tokens[piece] = found
        return found

    def _word(self, word: str) -> bytes:
        """The ids of a space and the word after it."""
        found = b"".join(map(self._pre_token, self.cut(" " + word)))
        if len(self.words) < MEMO_ENTRIES and "\n" not in word:
            self.words[word] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian 32-bit integers, as encode(text, add_special_tokens=False) gives them."""
        if not text:
            return b""
        if "  " in text or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        known, word = self.words.get, self._word
        return b"".join([*map(self._pre_token, self.cut(first)), *[known(w) or word(w) for w in rest]])


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One encoder per worker process, so that its memo outlives a task."""
    return ByteBpe(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)
