"""Exact duplicates by two passes over a Bloom filter, in DataFrame functions alone.

The first pass hashes every text to a slot of a filter and keeps the slots that more than one row hit; what leaves a task
is slots with the numbers of their rows, summed up before, not rows. The second pass sends a row on to be grouped only if
its slot is kept; every other text is alone for certain and passes straight through without a shuffle. The filter has
``SLOTS_EACH`` slots for a row, up to ``FILTER_BITS``, so that few rows meet by chance. The kept slots form 64-bit words,
and the side that is broadcast has at most FILTER_BITS / 64 rows whatever the input; beyond the bound a fuller filter
costs shuffled rows, never wrong results.

Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Of equal texts the row with the
largest doc_id stays, null ids last; of rows that repeat that doc_id all are marked kept. Empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseam.llm.common import packed, settle

FILTER_BITS = 1 << 27
SLOTS_EACH = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered_sha() -> Column:
    """Texts of one byte a character take the quicker lower()."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = F.octet_length(text) == F.length(text)
    return F.sha2(F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), 256)


def digests(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_sha256)``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), lowered_sha().alias("text_sha256"))


def repeated_slots(hashed: DataFrame, slot: str) -> DataFrame:
    """Words of the filter with the bits of all slots that more than one row hit."""
    hit = hashed.groupBy(slot).count().where("count > 1")
    bit = F.expr(f"shiftleft(1L, cast({slot} & 63 as int))")
    return hit.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def mark_exact(docs: DataFrame, filter_bits: int | None = None) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, a row for each row of ``docs``."""
    hashed = settle(digests(docs))
    if filter_bits is None:
        filter_bits = min(FILTER_BITS, 1 << max(16, (SLOTS_EACH * hashed.count()).bit_length()))
    if filter_bits < 64 or filter_bits & (filter_bits - 1):
        raise ValueError("the filter's bits must be a power of two, 64 at least")
    hashed = hashed.withColumn("slot", F.xxhash64("text_sha256").bitwiseAND(F.lit(filter_bits - 1)))
    kept = F.expr("coalesce(bits & shiftleft(1L, cast(slot & 63 as int)), 0) <> 0")
    tested = hashed.join(F.broadcast(repeated_slots(hashed, "slot")), F.shiftright("slot", 6) == F.col("word"), "left").select("doc_id", "text_sha256", kept.alias("maybe"))
    alone = tested.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    again = tested.where("maybe").select("doc_id", "text_sha256")
    # the sums are dealt anew, so that Spark may split the other side of the join where one text has many rows
    sums = again.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).repartition("text_sha256")
    grouped = again.join(sums, "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return alone.unionByName(grouped)


def drop_exact(docs: DataFrame, filter_bits: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, all columns. A row goes by its own text and doc_id, so that others with its doc_id, or
    without one, stay if their texts are kept."""
    gone = mark_exact(docs, filter_bits).where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_text")).distinct()
    here = docs.select(packed(docs).alias("row"), lowered_sha().alias("own_text"), F.col("doc_id").cast("long").alias("own_id"))
    return here.join(gone, (F.col("own_text") == F.col("gone_text")) & F.col("own_id").eqNullSafe(F.col("gone_id")), "left_anti").select("row.*")


SQL = """
with d as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents)
select doc_id, max(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
  doc_id = max(doc_id) over (partition by text_sha256) as kept, text_sha256
from d
"""
