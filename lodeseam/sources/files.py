"""A folder of source files as a DataFrame.

Spark's own file index leaves out names that begin with a dot or an underscore, so the tree is listed here: folder by
folder, level by level, each level's folders spread over the tasks. Folders on the ignore list are not entered.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.functions import paths as P

MOST_BYTES = 1_000_000


def decode(data: bytes) -> str:
    """UTF-8, else Latin-1; every kind of line end becomes a line feed."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    return text.replace("\r\n", "\n").replace("\r", "\n")


def decoded(data: Column) -> Column:
    """``decode`` of a column of bytes, in columns."""
    text = data.cast("string")
    return F.regexp_replace(F.when(F.is_valid_utf8(text), text).otherwise(F.decode(data, "ISO-8859-1")), "\r\n?", "\n")


def write_files(files: DataFrame, root: str) -> int:
    """Write ``(relative_path, data)`` below a folder that every task can reach, and return how many files there are."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["relative_path"], batch["data"]):
                at = os.path.join(root, path)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with open(at, "wb") as file:
                    file.write(data)
            yield pd.DataFrame({"n": [len(batch)]})

    return files.select("relative_path", "data").mapInPandas(work, "n long").agg(F.sum("n")).first()[0] or 0


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``(relative_path, size_bytes)`` of the files below a folder that every task can reach."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for folder in batch["relative_path"]:
                for e in os.scandir(os.path.join(root, folder)):
                    path = f"{folder}/{e.name}" if folder else e.name
                    if e.is_dir(follow_symlinks=False):
                        if e.name not in P.IGNORED_FOLDERS:
                            rows.append((path, None))
                    elif e.is_file():
                        rows.append((path, e.stat().st_size))
            yield pd.DataFrame({"relative_path": pd.Series([r[0] for r in rows], dtype=object), "size_bytes": pd.Series([r[1] for r in rows], dtype="Int64")})

    schema = "relative_path string, size_bytes long"
    level = spark.createDataFrame([("",)], "relative_path string")
    found = None
    while True:
        seen = level.repartition("relative_path").mapInPandas(work, schema).persist()
        files = seen.where("size_bytes is not null")
        found = files if found is None else found.unionByName(files)
        level = seen.where("size_bytes is null").select("relative_path")
        if level.isEmpty():
            return found


def scan(spark: SparkSession, root: str, repository_id: str) -> tuple[DataFrame, DataFrame]:
    """Files of supported languages with their text, and one row of counts.

    A file counts if its path isn't ignored; it is supported if its language is known, its size is from 1 byte to
    MOST_BYTES and its text isn't blank. Only the supported languages' files are opened."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.iloc[[i]]
                try:
                    with open(os.path.join(root, row["relative_path"].iloc[0]), "rb") as file:
                        yield row.assign(content=decode(file.read()))
                except OSError:
                    yield row.assign(content=None)

    path = F.col("relative_path")
    listed = list_files(spark, root).where(~P.ignored(path)).withColumn("language", P.language(path))
    open_ = listed.where(F.col("language").isNotNull() & F.col("size_bytes").between(1, MOST_BYTES))
    read_ = open_.repartition(F.col("relative_path")).mapInPandas(read, "relative_path string, size_bytes long, language string, content string")
    files = read_.where(F.col("content").rlike("(?U)\\S")).select(F.lit(repository_id).alias("repository_id"), "relative_path", "language", "size_bytes", "content")
    return files, summary(listed.select("relative_path"), files)


def summary(listed: DataFrame, files: DataFrame) -> DataFrame:
    """``(total_files, supported_files, ignored_files, languages)``, languages by count, then name."""
    by = files.groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "language", "n")))
    held = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("supported_files"), F.transform(ordered, lambda x: F.struct(x["language"].alias("language"), x["n"].alias("files"))).alias("languages"))
    total = listed.agg(F.count(F.lit(1)).alias("total_files"))
    # one row each
    return total.withColumn("one", F.lit(1)).join(held.withColumn("one", F.lit(1)), "one").select("total_files", "supported_files", (F.col("total_files") - F.col("supported_files")).alias("ignored_files"), "languages")
