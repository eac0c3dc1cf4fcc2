"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Rank file and pattern are parameters; each Python worker loads a file once. Long texts are cut at safe boundaries (before
white space that follows other characters, where no match of the pattern can span), so the regex engine sees short pieces;
a single run that is longer still (white space, or letters without a break) is matched by the `regex` library and its pieces
are encoded one at a time. Ids equal those of the library on the whole text. Decoding joins token bytes; it is exact for any
ids, also where a token ends inside a character.

A null text is an empty text and has no ids. Extra columns pass through `encode_texts` and `decode_ids`, whose ids and decoded
replace columns of those names; repeated rows are encoded each.
"""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free

#: Code points up to which a text goes to the library as it is, and about how long the pieces of longer ones are.
PIECE = 50_000


def _kept(key: tuple, make):
    """make() once per Python process; functions sent by value have no module of their own to keep it in."""
    store = sys.modules.setdefault("_lorekeep_kept", types.ModuleType("_lorekeep_kept")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def encoder(ranks: str, pattern: str):
    def make():
        import base64

        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    return _kept(("encoder", ranks, pattern), make)


def _pattern(pattern: str):
    import regex

    return _kept(("pattern", pattern), lambda: regex.compile(pattern))


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """text in pieces of about `size` code points, cut before white space that follows another character."""
    import regex

    cut, at = regex.compile(r"(?<=\S)(?=\s)"), 0
    while len(text) - at > size:
        m = cut.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode(text: str, ranks: str, pattern: str, size: int = PIECE) -> list[int]:
    enc = encoder(ranks, pattern)
    if len(text) <= size:
        return enc.encode_ordinary(text)
    out: list[int] = []
    for p in pieces(text, size):
        if len(p) <= 2 * size:
            out += enc.encode_ordinary(p)
        else:  # a run without a safe boundary
            for m in _pattern(pattern).finditer(p):
                out += enc._core_bpe.encode_single_piece(m[0].encode())
    return out


def decode(ids: list[int], ranks: str, pattern: str) -> bytes:
    return encoder(ranks, pattern).decode_bytes(ids)


def encode_texts(docs: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with ids, array<int>."""

    @F.pandas_udf("array<int>")
    def ids(s: pd.Series) -> pd.Series:
        return s.map(lambda t: encode(t or "", ranks, pattern))

    return docs.withColumn("ids", ids(F.col(text)))


def decode_ids(docs: DataFrame, ranks: str, pattern: str, ids: str = "ids") -> DataFrame:
    """docs with decoded, binary."""

    @F.pandas_udf("binary")
    def back(s: pd.Series) -> pd.Series:
        return s.map(lambda x: decode(list(x) if x is not None else [], ranks, pattern))

    return docs.withColumn("decoded", back(F.col(ids)))


def digests(docs: DataFrame, ranks: str, pattern: str, keep: list[str], text: str = "text") -> DataFrame:
    """keep columns with n_tokens, ids_sha256 and decoded_sha256; encodes and decodes in one pass over the rows. Kept columns go
    through as they are (Arrow, so that ids beside nulls stay whole)."""
    (own,) = free(docs, "_text")
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, ids, back = [], [], []
            for t in b.column(own):
                x = encode(t.as_py() or "", ranks, pattern)
                n.append(len(x))
                ids.append(hashlib.sha256(",".join(map(str, x)).encode()).hexdigest())
                back.append(hashlib.sha256(decode(x, ranks, pattern)).hexdigest())
            got = [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + got, names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(*keep, F.col(text).alias(own)).mapInArrow(run, schema)
