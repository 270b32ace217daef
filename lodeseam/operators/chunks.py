"""Files to chunks: by language to what cuts it, and what is done with chunks of any kind."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseam.functions.paths import CODE_LANGUAGES, COHESIVE_TYPES, literal_map
from lodeseam.operators import structured
from lodeseam.operators.code import declarations
from lodeseam.operators.markdown import markdown
from lodeseam.operators.structured import COLUMNS, KEY


def lines(files: DataFrame) -> DataFrame:
    """A row for each line: ``line_no`` from 1 and ``line``."""
    return files.select(*KEY, "language", F.posexplode(F.split(F.col("content"), "\r\n|\n|\r")).alias("at", "line")).withColumn("line_no", F.col("at") + 1).drop("at")


def _range(start: Column, end: Column) -> Column:
    return F.array(F.struct(start.cast("int").alias("start_line"), end.cast("int").alias("end_line")))


def _whole(files: DataFrame, chunk_type: Column) -> DataFrame:
    """One chunk for each file with text."""
    n = F.size(F.split(F.regexp_replace("content", "\r?\n\\z", ""), "\n"))
    real = files.where(F.col("content").rlike("(?U)\\S"))
    return real.select(*KEY, "language", chunk_type.alias("chunk_type"), F.lit(None).cast("string").alias("symbol_name"), F.lit(1).alias("symbol_start_line"), n.alias("symbol_end_line"), _range(F.lit(1), n).alias("source_ranges"), "content")


def cohesive(files: DataFrame) -> DataFrame:
    """Files that stay whole."""
    kind = F.element_at(literal_map(COHESIVE_TYPES), F.col("language"))
    return _whole(files.where(kind.isNotNull()), kind)


def whole_documents(files: DataFrame, chunk_type: str) -> DataFrame:
    return _whole(files, F.lit(chunk_type))


def dedupe(chunks: DataFrame, place: str) -> DataFrame:
    """The first, by ``place``, of chunks with one file, type, name and lines."""
    same = Window.partitionBy("file_path", "chunk_type", "symbol_name", "symbol_start_line", "symbol_end_line").orderBy(place)
    return chunks.withColumn("__n", F.row_number().over(same)).where("__n = 1").drop("__n")


#: Languages of each structured format.
FORMATS = (
    (structured.json, ("JSON", "Node Package Configuration", "TypeScript Configuration")),
    (structured.yaml, ("YAML", "Docker Compose")),
    (structured.toml, ("TOML", "Python Pipfile", "Python Project Configuration")),
    (structured.xml, ("XML", "Maven Configuration")),
    (structured.html, ("HTML", "JSP")),
    (structured.stylesheet, ("CSS", "SCSS")),
    (structured.sql, ("SQL",)),
    (markdown, ("Markdown",)),
)


def route(files: DataFrame) -> DataFrame:
    """Chunks of all files by language. A structured file that gives none stays whole; code that gives none, and files of
    other languages, give none. ``windows.split`` bounds their size afterwards."""
    parts = [cohesive(files), declarations(files.where(F.col("language").isin(*CODE_LANGUAGES)))] + [make(files.where(F.col("language").isin(*languages))) for make, languages in FORMATS]
    return reduce(DataFrame.unionByName, [p.select(*COLUMNS) for p in parts])


def to_documents(chunks: DataFrame) -> DataFrame:
    from lodeseam.functions.metadata import metadata

    return chunks.select(F.col("content").alias("page_content"), metadata().alias("metadata"))


def ranges_of_lines(rows: DataFrame, keys: tuple[str, ...], line: str) -> DataFrame:
    """Runs of consecutive lines as ``(start_line, end_line)``."""
    distinct = rows.select(*keys, line).distinct()
    run = F.col(line) - F.row_number().over(Window.partitionBy(*keys).orderBy(line))
    return distinct.withColumn("run", run).groupBy(*keys, "run").agg(F.min(line).alias("start_line"), F.max(line).alias("end_line")).drop("run")
