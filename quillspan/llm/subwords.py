"""Public tokenizers, loaded once per process.  Their files stay where they are; a path is a parameter."""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken

BYTE_BPE = "byte_bpe_50k"


@lru_cache(maxsize=4)
def byte_bpe(name: str = BYTE_BPE, path: str | None = None) -> tiktoken.Encoding:
    """The byte-level BPE `name`.json as ranks: the same ids, several times faster; the file's added tokens are left to ids_of()."""
    with open(path or public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def added_tokens(name: str = BYTE_BPE) -> tuple[dict[str, int], re.Pattern[str]]:
    """The added tokens of `name`.json with their ids, and what splits a text at them; each is one id wherever it stands."""
    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
        found = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return found, re.compile("(" + "|".join(map(re.escape, sorted(found, key=len, reverse=True))) + ")" if found else "(?!)")


def ids_of(text: str) -> list[int]:
    """The ids that `tokenizers` gives with add_special_tokens=False."""
    added, split = added_tokens()
    if not any(a in text for a in added):
        return byte_bpe().encode_ordinary(text)
    out: list[int] = []
    for piece in split.split(text):
        out += [added[piece]] if piece in added else byte_bpe().encode_ordinary(piece)
    return out


def encode(text: str | None) -> np.ndarray:
    """Ids of a whole text as little-endian unsigned 32-bit integers."""
    if not text:
        return np.zeros(0, "<u4")
    return np.array(ids_of(text), "<u4")
