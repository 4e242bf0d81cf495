"""Encoding of texts with a public byte-level tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.bpe import encoder

#: Fixed value: the pattern of the vocabulary files that splits text before merging, for Python and, with the white
#: space of Unicode spelled out, for the JVM.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
PIECES_JVM = PIECES.replace("White_Space", "IsWhite_Space")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces(text: Column) -> Column:
    """The pieces of a text, split by the JVM; null for texts with characters that its Unicode version doesn't know."""
    return F.when(~text.rlike(r"\p{Cn}"), F.regexp_extract_all(text, F.lit(PIECES_JVM), F.lit(0)))


def _flat_ids(path: str, parts: pa.ListArray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch: ids of the distinct pieces, start and end of each piece's ids there, and pieces up to each text."""
    if parts.null_count:
        find = regex.compile(PIECES).findall
        lists = [(find(t) if t else []) if p is None else p for p, t in zip(parts.to_pylist(), texts.to_pylist(), strict=True)]
        parts = pa.array(lists, pa.list_(pa.string()))
    coded = pc.dictionary_encode(parts.flatten())
    distinct = [x.encode() for x in coded.dictionary.to_pylist()]
    flat, start, end = encoder(path).lookup(distinct)
    at = np.asarray(coded.indices, np.int64) if len(coded) else np.empty(0, np.int64)
    offsets = np.asarray(parts.offsets, np.int64) - parts.offsets[0].as_py()
    return flat, start[at], end[at], offsets


def _batches(path: str, key: str, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, start, end, offsets = _flat_ids(path, b.column("_pieces"), b.column("_text"))
            size = end - start
            upto = np.concatenate([[0], np.cumsum(size)])
            if counts:
                out = pa.array(upto[offsets[1:]] - upto[offsets[:-1]])
            else:
                ids = flat[np.repeat(start - upto[:-1], size) + np.arange(upto[-1])]
                out = pa.ListArray.from_arrays(pa.array(upto[offsets].astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([b.column(key), out], names=[key, "n_tokens" if counts else "ids"])

    return run


def _split(df: DataFrame, key: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    split = pieces(t)
    return df.select(F.col(key).cast("long").alias(key), split.alias("_pieces"), F.when(split.isNull(), t).alias("_text"))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """key, ids: the token ids of each row's text, without special tokens, in the row's order in df (repeats are kept).

    Null and empty texts have an empty list. The whole text is encoded however long. Other columns aren't carried.
    vocabulary: a rank file of a byte-level tokenizer at the same place on every node.
    """
    return _split(df, key, text).mapInArrow(_batches(vocabulary or default_vocabulary(), key, False), f"{key} long, ids array<int>")


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """key, n_tokens: the number of ids that encode() gives."""
    return _split(df, key, text).mapInArrow(_batches(vocabulary or default_vocabulary(), key, True), f"{key} long, n_tokens long")
