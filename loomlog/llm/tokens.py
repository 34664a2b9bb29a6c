"""The public byte-level BPE, and positions in a text where encoding can be split without changing the result."""

from __future__ import annotations

import base64
import functools
import os
import sys
import unicodedata

import numpy as np

#: Folder of the public tokenizers' files; the path of a rank file may be given instead of this default.
DEFAULT_DIR = "/opt/tokenizers"
#: Fixed value: the pre-tokenisation pattern that belongs to the public byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ranks(name: str) -> str:
    return os.path.join(DEFAULT_DIR, f"{name}.tiktoken")


def default_ranks() -> str:
    return ranks("byte_bpe_50k")


def ship(spark, path: str | None = None) -> None:
    """Send the rank file to all executors, so that only the driver's machine needs it."""
    path = path or default_ranks()
    if os.path.exists(path) and not spark.sparkContext.master.startswith("local["):
        spark.sparkContext.addFile(path)  # the same file again is no work


def _open(path: str):
    if not os.path.exists(path):
        from pyspark import SparkFiles

        path = SparkFiles.get(os.path.basename(path))
    return open(path, "rb")


@functools.lru_cache(maxsize=2)
def encoding(path: str | None = None):
    """The encoder of a rank file, once per worker. Texts that look like special tokens are ordinary text."""
    import tiktoken

    with _open(path or default_ranks()) as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=2)
def token_bytes(path: str | None = None) -> np.ndarray:
    """Bytes of each token id."""
    e = encoding(path)
    out = np.zeros(e.max_token_value + 1, np.int64)
    for i in range(len(out)):
        try:
            out[i] = len(e.decode_single_token_bytes(i))
        except KeyError:
            pass
    return out


@functools.lru_cache(maxsize=2)
def id_type(path: str | None = None) -> type:
    """The narrowest type that holds all ids."""
    return np.uint16 if encoding(path).max_token_value < 1 << 16 else np.uint32


LETTER, NUMBER, SPACE, OTHER, UNSURE = range(5)


@functools.lru_cache(maxsize=1)
def char_class() -> np.ndarray:
    """The pattern's class of every code point. Unassigned ones are unsure: libraries' tables may differ there."""
    kinds = {"L": LETTER, "N": NUMBER, "Z": SPACE}
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for cp in range(sys.maxunicode + 1):
        c = unicodedata.category(chr(cp))
        table[cp] = UNSURE if c in ("Cn", "Co", "Cs") else kinds.get(c[0], OTHER)
    for cp in (9, 10, 11, 12, 13, 0x85):
        table[cp] = SPACE
    for cp in (0x1C, 0x1D, 0x1E, 0x1F, 0x180E, 0x200B):
        table[cp] = UNSURE
    return table


def safe_cuts(classes: np.ndarray) -> np.ndarray:
    """For each position i > 0: is there a token boundary before character i whatever stands around?

    A run of letters or of numbers ends where another class follows; the next pre-token starts there and the pattern looks
    back at nothing, so both sides encode alone as they do together.
    """
    out = np.zeros(len(classes), bool)
    before, after = classes[:-1], classes[1:]
    out[1:] = (before <= NUMBER) & (before != after) & (after != UNSURE)
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def class_of(cps: np.ndarray) -> np.ndarray:
    return char_class()[cps]
