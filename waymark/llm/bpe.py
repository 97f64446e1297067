"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from waymark.llm.common import lists, with_columns

#: Characters of a text that go to the library at once.
PIECE = 50_000
_EDGE = re.compile(r"(?<=\S)(?=\s)")


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The encoding of a rank file (lines of base64 token and rank); loaded once in each worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """A long text cut where the pattern must begin a new match anyway: between a character that is
    no white space and one that is. No alternative of the pattern goes from the one to the other,
    none looks back, and the only look ahead is made from white space."""
    start = 0
    while len(text) - start > size:
        m = _EDGE.search(text, start + size)
        if m is None:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def _encode(args: tuple[str, str], texts: list) -> list[pa.Array]:
    enc = encoding(*args)
    ids = []
    for t in texts:
        one = []
        for p in pieces(t or ""):
            one += enc.encode_ordinary(p)
        ids.append(np.array(one, dtype=np.int32))
    return [lists(np.concatenate(ids), np.cumsum([len(x) for x in ids]))]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the token ids of each text as array<int>; no special tokens.

    A null or empty text has an empty array. A column of the name ``ids`` is replaced; all others,
    repeated rows and ties are kept as they are. Texts of any length are encoded whole, in pieces. An empty table gives no rows.
    """
    return with_columns(df, text, f"{ids} array<int>", _encode, lambda: (path, pattern))


def _both(args: tuple[str, str], texts: list) -> list[pa.Array]:
    ids = _encode(args, texts)
    return ids + _decode(args, ids[0].to_pylist())


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", raw: str = "raw") -> DataFrame:
    """:func:`encode` and then :func:`decode` of its ids, in one pass."""
    return with_columns(df, text, f"{ids} array<int>, {raw} binary", _both, lambda: (path, pattern))


def _decode(args: tuple[str, str], rows: list) -> list[pa.Array]:
    enc = encoding(*args)
    return [pa.array([enc.decode_bytes(r) if r is not None else None for r in rows], pa.binary())]


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", raw: str = "raw") -> DataFrame:
    """df with the bytes that each array of ids stands for; null for null, empty for none. An id without a rank fails."""
    return with_columns(df, ids, f"{raw} binary", _decode, lambda: (path, pattern))
