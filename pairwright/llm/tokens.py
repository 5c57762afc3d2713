"""Byte-level BPE ids of whole texts, from a public vocabulary file whose path is a parameter."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np


class ByteBpe:
    """Ids as little-endian unsigned 32-bit bytes; the JSON file's added tokens are one id wherever a text holds them."""

    def __init__(self, ranks_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
            self.added = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks={k: v for k, v in ranks.items() if v not in self.added.values()}, special_tokens=self.added)

    def encode(self, text: str) -> bytes:
        found = self.encoding.encode(text, allowed_special="all") if any(x in text for x in self.added) else self.encoding.encode_ordinary(text)
        return np.array(found, dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def byte_bpe(ranks_path: str) -> ByteBpe:
    """One for each Python worker."""
    return ByteBpe(ranks_path)


def default_ranks_path() -> str:
    """The ranks of byte_bpe_50k.json, which give the same ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")
