"""Token counts through a digest cache.

The cache is a Parquet folder of ``(tokenizer, digest, n_tokens)``: the SHA-256 digest of a normalised text, under the
digest of the tokenizer's file. Counting joins the digests of the documents to it, encodes one text for each digest that
it lacks, appends those counts, and joins the documents to what is stored then. A later call with the same folder encodes
only texts that are new to it; another tokenizer, or another version of one, has counts of its own.

Normalising joins texts only where the count is the same for certain: null is the empty text, and a run of white space is
one space where the tokenizer's own normaliser makes it one. ``n_bytes`` is of the text as it was.

Texts are never shuffled for it: of the rows with a missing digest the least doc_id is chosen by digests alone, and a
semi-join picks those rows from the texts, which go to the tokenizer where they lie. The chosen rows are broadcast as
64-bit hashes up to ``MOST_SENT`` of them; beyond that the same join shuffles. A text that a third of all rows share is
one digest, summed up before it moves; the join that gives each row its count has tables on both sides, so that Spark
splits a hot digest.

Nulls: a null text counts as empty, a row without a doc_id is counted like others. Rows that repeat a doc_id are counted
each by its own text. Empty input gives no rows and appends nothing. Digests that the cache holds twice (two calls at the
same time) are one. Extra columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.llm.common import pieces, settle, short_batches

#: Rows broadcast to choose the texts to encode: some 150 MB.
MOST_SENT = 2_000_000
LIMIT = 1024
SCHEMA = "digest binary, n_tokens long, tokenizer string"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def version(path: str) -> str:
    """What a tokenizer is known by in the cache: its kind and the digest of its file."""
    with open(path, "rb") as file:
        return f"{path.rpartition('.')[2]}-{hashlib.sha256(file.read()).hexdigest()}"


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts of tokens as the library gives them: tokenizers for .json, sentencepiece for .model, without added special
    tokens, truncation or padding. Where the rank file of the same vocabulary lies beside the .json, its ids are the same
    (a test compares all code points) at three times the speed."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    if os.path.exists(path.removesuffix(".json") + ".tiktoken"):
        from lodeseam.llm import packing

        ranks = packing.load(path.removesuffix(".json") + ".tiktoken")
        return lambda texts: [len(ranks.encode(x, allowed_special="all")) for x in texts]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def normalised(text: Column, path: str) -> Column:
    """The text that the digest is of."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as file:
            own = json.load(file)["normalizer"] or {}
        steps = own.get("normalizers", [own])
        if any(s.get("type") == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " " for s in steps):
            return F.regexp_replace(text, "[ \t\n\r]+", " ")
    return text


def stored(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """``(digest, n_tokens)`` of one tokenizer."""
    return spark.read.schema(SCHEMA).parquet(cache).where(F.col("tokenizer") == tokenizer).select("digest", "n_tokens")


def append(counts: DataFrame, cache: str, tokenizer: str) -> None:
    counts.withColumn("tokenizer", F.lit(tokenizer)).write.mode("append").partitionBy("tokenizer").parquet(cache)


def encode(texts: DataFrame, path: str) -> DataFrame:
    """``(digest, n_tokens)`` of ``(mark, digest, text)``; a task encodes what it meets again once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = counter(path), set()
        for batch in pieces(batches, "text", 4 << 20):
            digests, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            new = {d: t for d, t in zip(digests, texts) if d not in seen}
            seen.update(new)
            if new:
                yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary()), pa.array(count(list(new.values())), pa.int64())], ["digest", "n_tokens"])

    with short_batches(texts.sparkSession):
        return texts.select("digest", "text").mapInArrow(work, "digest binary, n_tokens long")


def count_tokens(docs: DataFrame, cache: str, path: str | None = None, limit: int = LIMIT, most_sent: int = MOST_SENT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit, digest)``, a row for each document. ``cache`` is a folder that all
    machines share; it is made where there is none."""
    path = path or vocabulary_path()
    spark, tokenizer = docs.sparkSession, version(path)
    spark.createDataFrame([], SCHEMA).write.mode("append").partitionBy("tokenizer").parquet(cache)

    content = normalised(F.col("text"), path)
    texts = docs.select("doc_id", F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("n_bytes"), F.unhex(F.sha2(content, 256)).alias("digest"), content.alias("text"))
    keyed = settle(texts.drop("text"))
    each = settle(keyed.groupBy("digest").agg(F.min(F.struct("doc_id")).alias("least")))
    mark = lambda doc_id: F.xxhash64("digest", doc_id).alias("mark")
    owners = settle(each.join(stored(spark, cache, tokenizer), "digest", "left_anti").select(mark("least.doc_id")))
    n_owners = owners.count()
    if n_owners:
        chosen = texts.withColumn("mark", mark("doc_id")).join(F.broadcast(owners) if n_owners <= most_sent else owners, "mark", "left_semi")
        append(encode(chosen, path), cache, tokenizer)
    known = each.select("digest").join(stored(spark, cache, tokenizer), "digest").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counted = keyed.join(settle(known), "digest", "left")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "digest")
