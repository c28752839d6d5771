"""Identifiers of a byte-level BPE tokenizer file, for many texts.

The file is the tokenizers library's. Ordinary texts are encoded from the file's own vocabulary by
the tiktoken library, which gives the same identifiers over three times as fast; texts with special
tokens, or with very long runs with or without white space, by the tokenizers library itself.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Fixed value: how byte-level pre-tokenizers cut a text.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Length of runs whose cost the faster library doesn't bound.
LONG_RUN = 1000
#: Bytes to 1 where they are white space, else to 0.
SPACES = bytes(b in b" \t\n\r\f\v" for b in range(256))


def has_long_run(text: bytes) -> bool:
    """Whether ``LONG_RUN`` bytes in a row are white space, or none of them is."""
    if len(text) < LONG_RUN:
        return False
    marks = text.translate(SPACES)
    return b"\0" * LONG_RUN in marks or b"\1" * LONG_RUN in marks


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteEncoder:
    """Encodes UTF-8 texts to arrays of unsigned 32-bit identifiers."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        model = json.loads(self.tokenizer.to_str())["model"]
        letters = byte_letters()
        added = set(self.special)
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token.encode() not in added}
        self.fast = tiktoken.Encoding("file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: bytes) -> np.ndarray:
        if any(s in text for s in self.special) or has_long_run(text):
            return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, dtype="<u4")
        return self.fast.encode_to_numpy(text.decode(), disallowed_special=())


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteEncoder:
    """One encoder per worker process and file."""
    return ByteEncoder(path)
