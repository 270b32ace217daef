"""Near-duplicates by similarity of word shingles, for the corpus pipeline.

Two texts are linked if the sets of their ``SHINGLE``-word shingles have a Jaccard similarity of ``LEAST`` or more; a
text of fewer words is one shingle. Candidates share one of ``BANDS`` bands of ``ROWS`` MinHashes: a pair of similarity
s is missed with probability (1 - s**ROWS)**BANDS, one in 1300 at 0.8 and fewer above. Every link is verified on the
sets, as 64-bit hashes, before it joins two texts. Texts of equal words are one node and are never missed.

Nulls: a null text has no words and is like any other text without words; rows without a doc_id are never linked. Rows
that repeat a doc_id must repeat its text. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.llm.common import components, local_forest, pieces, settle
from lodeseam.llm.simhash_dedup import BUCKET, edge_batches, parted, runs

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 10, 3
SEED = 42

_RNG = np.random.default_rng(17)
_FLIP = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_MULT = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_PLACE = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Hashes of the distinct shingles, in order."""
    found = {xxhash.xxh64_intdigest(b" ".join(words[i : i + SHINGLE]), SEED) for i in range(max(1, len(words) - SHINGLE + 1))}
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def bands(hashes: np.ndarray) -> list[int]:
    """Names of the bands' buckets."""
    least = np.full(BANDS * ROWS, ~np.uint64(0), np.uint64)
    for i in range(0, len(hashes), 4096):
        mixed = (hashes[i : i + 4096, None] ^ _FLIP) * _MULT
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _PLACE
        least = np.minimum(least, mixed.min(axis=0))
    return [xxhash.xxh64_intdigest(row.tobytes(), k) >> 1 for k, row in enumerate(least.reshape(BANDS, ROWS))]


def marks(docs: DataFrame) -> DataFrame:
    """``(doc_id, name, size, bands)``; equal names, equal words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            names, sizes, every = [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                hashes = shingles(words)
                names.append(xxhash.xxh3_128_intdigest(b" ".join(words)) >> 65)
                sizes.append(len(hashes))
                every.append(bands(hashes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), pa.array(every, pa.list_(pa.int64()))], ["doc_id", "name", "size", "bands"])

    return docs.mapInArrow(work, "doc_id long, name long, size int, bands array<long>")


def alike(size: np.ndarray, one: int) -> np.ndarray:
    return np.minimum(size, one) >= LEAST * np.maximum(size, one)


def partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each bucket that have a partner of like size there, which is next to them in order of size."""
    names = ("bucket", "part", "fp", "node", "size")
    for run in runs(batches):
        order = np.argsort(run["size"], kind="stable")
        near = run["size"][order][:-1] >= LEAST * run["size"][order][1:]
        has = np.zeros(len(order), bool)
        has[:-1] |= near
        has[1:] |= near
        if has.any():
            yield pa.RecordBatch.from_arrays([pa.array(run[c][order][has]) for c in names], list(names))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both / (len(a) + len(b) - both)


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join all that verified pairs of a bucket join; joined pairs are not tested again."""

    def found() -> Iterator[tuple[int, int]]:
        for run in runs(batches):
            sets = [np.frombuffer(x, np.uint64) for x in run["held"]]
            group, size = np.arange(len(sets)), run["size"]
            for q in range(1, len(sets)):
                left = np.flatnonzero(alike(size[:q], size[q]))
                while True:
                    left = left[group[left] != group[q]]
                    if not len(left):
                        break
                    j, left = int(left[-1]), left[:-1]
                    if similarity(sets[q], sets[j]) >= LEAST:
                        group[group == group[q]] = group[j]
                        yield int(run["node"][q]), int(run["node"][j])

    yield from edge_batches(found())


def sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, held)``: the shingles of some documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            held = [shingles(words_of(t)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary())], ["node", "held"])

    wanted = docs.join(nodes, docs["doc_id"] == nodes["node"], "left_semi").dropDuplicates(["doc_id"])
    return wanted.select("doc_id", "text").mapInArrow(work, "node long, held binary")


def groups(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``(doc_id, component_id)`` for every row; component_id is the least doc_id reachable over links."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = settle(marks(texts))
    codes = settle(marked.groupBy("name").agg(F.min("doc_id").alias("node"), F.first("size").alias("size"), F.first("bands").alias("bands"))).where("node is not null")
    rows = codes.select("node", F.col("name").alias("fp"), "size", F.explode("bands").alias("bucket"))
    met = settle(parted(rows, codes.count() * BANDS, bucket).mapInArrow(partnered, "bucket long, part long, fp long, node long, size int"))
    named = met.join(sets_of(texts, met.select("node").distinct()), "node").select("bucket", "part", "node", "size", "held")
    links = named.repartition("bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(lambda batches: local_forest(verified(batches)), "a long, b long")
    joined = codes.join(components(links, stars=True), "node", "left").select("name", F.coalesce("component", "node").alias("component_id"))
    out = marked.join(joined, "name", "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
