"""Public byte-level tokenizers: rank files, encoders per worker, and byte offsets of tokens."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np

#: Folder of the public tokenizers; never copied into the repository.
TOKENIZERS = os.environ.get("LOCLAKE_TOKENIZERS", "/opt/tokenizers")
BPE_50K = "byte_bpe_50k.tiktoken"
BPE_MULTI = "byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of these rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for Java, whose \s knows only ASCII; the suffixes as one alternative, runs without a way back.
_SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
JAVA_PATTERN = rf"'(?:[stmd]|re|ve|ll)| ?\p{{L}}++| ?\p{{N}}++| ?[^{_SPACE}\p{{L}}\p{{N}}]++|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def path_of(name: str, folder: str = TOKENIZERS) -> str:
    return os.path.join(folder, name)


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(path: str) -> np.ndarray:
    """Bytes that each token stands for."""
    r = ranks(path)
    out = np.zeros(max(r.values()) + 1, np.int64)
    for b, i in r.items():
        out[i] = len(b)
    return out


def encode(text: str | None, path: str) -> np.ndarray:
    """Token ids without special tokens; none for null and empty texts."""
    if not text:
        return np.empty(0, np.uint32)
    try:
        return encoding(path).encode_to_numpy(text, disallowed_special=())
    except UnicodeEncodeError:  # lone surrogates have no bytes of their own
        return encoding(path).encode_to_numpy(text.encode("utf-16", "surrogatepass").decode("utf-16", "replace"), disallowed_special=())


def starts_character(data: bytes, at: np.ndarray) -> np.ndarray:
    """Whether a character begins (or the text ends) at byte offsets."""
    raw = np.frombuffer(data + b"\0", np.uint8)
    return (raw[at] & 0xC0) != 0x80
