"""A corpus pipeline over ``documents``: toxic documents go, repeated lines go, of near-duplicates one stays, secrets
are masked, and what is left is packed into sequences of neighbours.

Each stage works on the documents that the stage before it left and returns their columns; the last returns the pieces
of the packed sequences. Rows without a doc_id are never called duplicates. Equal rows are one document; rows that repeat a
doc_id with another text are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.llm import common, line_dedup, packing, secret_scan, shingle_dedup, simhash_dedup, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2. Labels of held-out rows are not learned from, as in op2."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out())
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3. A document keeps its other lines, be they none."""
    free = max(docs.columns, key=len, default="") + "_"
    return line_dedup.remove_lines(docs, name=free).drop(free)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: fingerprints at most two bits apart are linked through the index over their Gray order. Texts of like
    five-word shingles, which fingerprints tell less surely, are linked besides. The smallest doc_id of all that links reach
    stays. A document is a doc_id and a text: rows that repeat a doc_id with another text are judged by their own."""
    named = docs.where("doc_id is not null").select(common.packed(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("own"), "text")
    texts = named.select(F.col("own").alias("doc_id"), "text")
    found = [operator.groups(texts).select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")).where("a <> b") for operator in (simhash_dedup, shingle_dedup)]
    groups = common.components(found[0].unionByName(found[1]))
    ids = named.select("own", "id").distinct()
    firsts = ids.join(groups, ids["own"] == groups["node"], "left").groupBy(F.coalesce("component", "own").alias("group")).agg(F.min(F.struct("id", "own")).alias("first"))
    keep = firsts.select(F.col("first.own").alias("keep"))
    one = named.join(keep, F.col("own") == F.col("keep"), "left_semi").dropDuplicates(["own"]).select("row.*")
    return one.unionByName(docs.where("doc_id is null"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6."""
    packed = packing.pack(docs)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

#: No stage but the masking by patterns can be said in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what each stage leaves is written to the shared checkpoint folder and read again."""
    folder = common.scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs_out = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(docs_out)
        docs = spark.read.parquet(docs_out)
    return docs
