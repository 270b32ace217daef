"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into Python objects at a time.
SLICE_BYTES = 8 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where the session names none and runs in one process, as in
    tests. On a cluster that names none this raises, as other machines would not see a local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    named = named or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = f"file://{tempfile.mkdtemp(prefix='lodeseam-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written once to the shared checkpoint folder and survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """As ``settle``, for rows that are read several times, each time in few of their columns. Hashes fill dictionaries in
    vain, so that none are made."""
    path = scratch(df.sparkSession, name)
    df.write.option("parquet.enable.dictionary", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def short_batches(spark: SparkSession, rows: int = 2000, size: int | None = None) -> Iterator[None]:
    """What is planned meanwhile hands its Python tasks batches of so many rows, as texts may be long, and of about so many
    bytes, if given."""
    name, other = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before, bytes_before = spark.conf.get(name), spark.conf.get(other)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    if size is not None:
        spark.conf.set(other, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)
        spark.conf.set(other, bytes_before)


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES // 2) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``limit`` bytes of ``column``, or one row. Between tasks a Python worker
    gives back what it no longer uses, as workers live on and Spark counts all of them to their executor."""
    give_back()
    try:
        yield from cut(batches, column, limit)
    finally:
        give_back()


def freed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work``, whose worker gives memory back once all that the task kept is gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return run


def give_back() -> None:
    """Hand free memory of Arrow and of the C library back to the system, where the latter can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def cut(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index(column)).nbytes
        if sizes <= limit or batch.num_rows <= 1:
            if batch.num_rows:
                yield batch
            continue
        lengths = pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if held and held + (n or 0) > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        yield batch.slice(start)


def local_forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars ``(a, b)``, b the least node, that join what the links of a task's slices join; a slice is a bound number."""
    for batch in batches:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = root[x]
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        stars = [(x, find(x)) for x in root]
        stars = [(a, b) for a, b in stars if a != b]
        if stars:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*stars)], ["a", "b"])


def components(edges: DataFrame, stars: bool = False) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, component)``; component is the least node of the group.

    Large-star and small-star steps take turns: every node's larger neighbours are hung to the least node that its
    smaller neighbours offer, then its smaller neighbours and itself to the least of them, until only stars around the
    groups' least nodes are left. The rounds grow with the logarithm of a group's size (a test bounds them on shuffled
    paths). Minima are summed up before they move, and what a join reads goes on by another key, so that Spark splits a
    hot node's rows; two sums a round reach the driver. Null ends and loops are left out; no edges give no rows. ``stars``: the
    edges went through ``local_forest`` in the task that found them, which spares a second Python worker beside its own.
    """
    real = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    held = settle((real if stars else real.mapInArrow(local_forest, "a long, b long")).distinct())
    before = None
    while True:
        sums = held.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("mark")).first()
        if (sums["n"], sums["mark"]) == before:
            return held.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(held.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = (sums["n"], sums["mark"])
        least = lambda rows, name: rows.groupBy(F.col("a").alias(name)).agg(F.min("b").alias("m"))
        large = held.join(least(held, "b"), "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        large = settle(large)
        small = large.join(least(large, "a"), "a")
        hung = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(large.groupBy("a").agg(F.min("b").alias("b")))
        held = settle(hung.distinct())


def repeated_ids(docs: DataFrame) -> DataFrame:
    """A filter of the doc_ids that stand before more than one row; only they are read."""
    several = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    return settle(bloom_words(several, "doc_id"))


def owned(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Adds ``own``, which tells rows with one doc_id but different texts apart, beside the doc_id: a hash of the text, and 0
    where the doc_id stands before one row. ``rows`` has doc_id as a long, text, and no names of a filter's columns."""
    return maybe_in(rows, "doc_id", repeated).withColumn("own", F.when(F.col("__maybe"), F.hash("text")).otherwise(0)).drop("__maybe")


def packed(df: DataFrame, *but: str) -> Column:
    """All columns but some as one, so that no name of theirs meets a helper's."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`").alias(c) for c in df.columns if c not in but])


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of the shared checkpoint folder, for a table that outlives one plan."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bloom_words(keys: DataFrame, column: str, bits: int = 1 << 24) -> DataFrame:
    """A Bloom filter of a column's values as ``(word, mask)``: at most bits / 64 rows, whatever the input."""
    slot = F.xxhash64(column).bitwiseAND(F.lit(bits - 1))
    return keys.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("mask"))


def maybe_in(rows: DataFrame, column: str, words: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """Adds ``__maybe``: false only where the filter lacks the column's value for certain. The filter is broadcast, as its
    size is bound; a full one costs time, never results."""
    slot = rows.withColumn("__slot", F.xxhash64(column).bitwiseAND(F.lit(bits - 1)))
    named = words.select(F.col("word").alias("__word"), F.col("mask").alias("__mask"))
    hit = F.expr("coalesce(__mask & shiftleft(1L, cast(__slot & 63 as int)), 0) <> 0")
    return slot.join(F.broadcast(named), F.shiftright("__slot", 6) == F.col("__word"), "left").withColumn("__maybe", hit).drop("__slot", "__word", "__mask")


def filter_bits(keys: DataFrame, column: str, bits: int = 1 << 24) -> np.ndarray:
    """A filter of a column of hashes for tasks in Python: bits / 8 bytes on the driver, whatever the input."""
    slots = keys.select(F.col(column).bitwiseAND(F.lit(bits - 1)).alias("slot")).groupBy(F.shiftright("slot", 6).alias("word"))
    words = slots.agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("mask")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64)
    return out


def in_filter(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False only for hashes that the filter lacks for certain."""
    slot = hashes & (64 * len(held) - 1)
    return (held[slot >> 6] >> (slot & 63)) & 1 == 1
