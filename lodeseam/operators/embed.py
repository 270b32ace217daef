"""An embedder interface, and a deterministic one that hashes tokens, for where there is no model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseam.functions.batches import sliced
from lodeseam.functions.text import token_sequence

DIMENSION = 64
TOKEN_CAPACITY = 4096
#: From batches of token lists to a matrix of one row each.
Embedder = Callable[[list[list[str]]], np.ndarray]


def hashing_embedder(dimension: int = DIMENSION) -> Embedder:
    """Tokens to signed places by their CRC-32, rows to length one."""
    import zlib

    def embed(texts: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(texts), dimension))
        for row, tokens in zip(out, texts):
            codes = np.array([zlib.crc32(t.encode()) for t in tokens], np.int64)
            np.add.at(row, codes % dimension, np.where(codes >> 16 & 1, 1.0, -1.0))
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length == 0, 1, length)

    return embed


def embed(rows: DataFrame, text: str, embedder: Embedder | None = None, dimension: int = DIMENSION) -> DataFrame:
    """Adds ``values``; the embedder is made once for each task and gets a few MB of tokens at a time."""
    kind = T.StructType([*[f for f in rows.schema.fields], T.StructField("values", T.ArrayType(T.DoubleType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = embedder or hashing_embedder(dimension)
        for batch in sliced(batches):
            tokens = batch.column(batch.num_columns - 1).to_pylist()
            values = pa.array(list(model([t or [] for t in tokens])), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], values], [*batch.schema.names[:-1], "values"])

    return rows.withColumn("__tokens", token_sequence(text)).mapInArrow(work, kind)


def within_capacity(text: Column, capacity: int = TOKEN_CAPACITY) -> Column:
    """The number of white-space tokens; a text above the capacity stops the query, it is never cut."""
    n = F.size(F.filter(F.split(text, "(?U)\\s+"), lambda x: x != ""))
    return F.when(n <= capacity, n.cast("long")).otherwise(F.raise_error(F.concat(F.lit("tokens above the capacity: "), n.cast("string"))).cast("long"))
