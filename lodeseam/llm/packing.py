"""Packing of neighbouring documents along a Hilbert curve.

Each document's token counts are hashed to ``BINS`` bins, scaled to length one and projected to ``AXES`` dimensions by
a fixed random matrix; the point's place on a Hilbert curve is its key. Documents are range-sorted by (key, doc_id) and
their tokens (each document's ids, then the end id) are laid end to end along the curve, cut every ``SIZE`` tokens. The
last stretch is cut into powers of two, which need no padding, so nothing is padded at all.

Only (key, doc_id, length) is sorted. A partition's total is one number, and the running sum of those numbers places
every document; the ids are joined to their places afterwards and never pass through one task.

Nulls: a null text is empty and has the end id alone. Rows that repeat a doc_id, and rows without one, are packed each
for itself, in an order set by their place in the sorted partition. Empty input gives no rows.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseam.llm.common import freed, pieces, settle

SIZE = 1024
END_ID = 0
BINS = 256
AXES = 4
ORDER_BITS = 12


#: Kinds of number that hold the ids between the stages; every id of the vocabulary fits.
HELD = "<u2"


def vocabulary_path() -> str:
    """The ranks of byte_bpe_50k.json, the same vocabulary: its ids are equal (tests compare them), five times as quick.
    The added tokens, which ranks lack, are read from the JSON beside it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def added_tokens(path: str) -> dict[str, int]:
    """Ids of the tokens that the library finds whole wherever they stand in a text."""
    with open(path.removesuffix(".tiktoken") + ".json", encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        raise ValueError("an added token depends on what stands beside it")
    return {t["content"]: t["id"] for t in added}


def load(path: str) -> tiktoken.Encoding:
    import public_tokenizers

    with open(path, "rb") as file:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
    added = added_tokens(path)
    if max([*ranks.values(), *added.values()]) > np.iinfo(HELD).max:
        raise ValueError("the vocabulary has ids above 65535")
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of rows of cell numbers, each below 2**bits: Skilling's transform, then interleaving."""
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    step = 1 << (bits - 1)
    while step > 1:
        below = step - 1
        for i in range(axes):
            set_ = (x[i] & step) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(set_, x[0] ^ below, x[0] ^ swap)
            x[i] ^= swap
        step >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip, step = np.zeros_like(x[0]), 1 << (bits - 1)
    while step > 1:
        flip = np.where((x[axes - 1] & step) != 0, flip ^ (step - 1), flip)
        step >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def projection() -> np.ndarray:
    return np.random.default_rng(11).standard_normal((BINS, AXES))


def curve_keys(counts: np.ndarray) -> np.ndarray:
    """Keys of rows of bin counts."""
    length = np.linalg.norm(counts, axis=1, keepdims=True)
    points = (counts / np.where(length == 0, 1, length)) @ projection()
    cells = np.clip((points + 4.0) / 8.0 * (1 << ORDER_BITS), 0, (1 << ORDER_BITS) - 1)
    return hilbert_key(cells.astype(np.int64), ORDER_BITS)


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """``(row, doc_id, key, n, held)``; held are a document's ids, the end id last, compressed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, press = load(path), zstandard.ZstdCompressor(level=1)
        for batch in pieces(batches, "text", 4 << 20):
            ids = [np.array([*model.encode(t or "", allowed_special="all"), END_ID], HELD) for t in batch.column(1).to_pylist()]
            counts = np.stack([np.bincount((x.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24), minlength=BINS) for x in ids]).astype(float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(curve_keys(counts)), pa.array([len(x) for x in ids], pa.int64()), pa.array([press.compress(x.tobytes()) for x in ids], pa.binary())],
                ["doc_id", "key", "n", "held"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(freed(work), "doc_id long, key long, n long, held binary").withColumn("row", F.monotonically_increasing_id())


def places(sized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(row, at)``: the tokens before each document along the curve; and one row with the total."""
    near = F.spark_partition_id().alias("part")
    order = ["key", "doc_id", "row"]
    parts = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settle(sized.repartitionByRange(parts, *order).select("row", "doc_id", "key", "n", near))
    sums = ranged.groupBy("part").agg(F.sum("n").alias("sum"))
    # a row for each partition
    before = sums.select("part", F.coalesce(F.sum("sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    placed = ranged.withColumn("inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(before), "part")
    return placed.select("row", (F.col("before") + F.col("inside")).alias("at")), sums.agg(F.sum("sum").alias("total"))


def cuts(total: int, size: int) -> list[tuple[int, int]]:
    """Where the sequences after the last whole one begin, and their lengths: powers of two, longest first."""
    at, left, out = total - total % size, total % size, []
    while left:
        length = 1 << (left.bit_length() - 1)
        out.append((at, length))
        at, left = at + length, left - length
    return out


def pack(docs: DataFrame, size: int = SIZE, path: str | None = None) -> DataFrame:
    """``(doc_id, start, length, doc_tokens, sequence_id, offset, ids)``, a row for each piece of a document."""
    path = path or vocabulary_path()
    held = settle(tokenized(docs, path))
    where, sums = places(held.select("row", "doc_id", "key", "n"))
    total = sums.first()["total"] or 0
    tail = cuts(total, size)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, unpress = total // size, zstandard.ZstdDecompressor()
        for batch in pieces(batches, "held", 2 << 20):
            rows = []
            for doc_id, n, held_ids, at in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(unpress.decompress(held_ids), HELD).astype("<u4").tobytes()
                start = 0
                while start < n:
                    spot = at + start
                    number, begin, length = spot // size, spot - spot % size, size
                    if number >= full:
                        number, begin, length = next((full + i, b, m) for i, (b, m) in enumerate(tail) if b <= spot < b + m)
                    stop = min(n, start + begin + length - spot)
                    rows.append((doc_id, start, stop - start, n, number, spot - begin, ids[4 * start : 4 * stop]))
                    start = stop
            kinds = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    joined = held.select("row", "doc_id", "n", "held").join(where, "row").select("doc_id", "n", "held", "at")
    return joined.mapInArrow(freed(work), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
