"""Chunk metadata, ids and labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: In the order of their names, as the canonical JSON has them.
KEYS = ("chunk_type", "file_path", "language", "repository_id", "source_ranges", "symbol_end_line", "symbol_name", "symbol_start_line")
FLAT = tuple(k for k in KEYS if k != "source_ranges")
# What each status shows.
PROGRESS = {"queued": 0, "cloning": 10, "scanning": 25, "chunking": 45, "embedding": 60, "indexing": 85, "ready": 100}
ACTIVE = ("queued", "cloning", "scanning", "chunking", "embedding", "indexing")
FAILED_STEPS = (12, 28, 48, 68, 91)


def metadata() -> Column:
    """The eight keys of a chunk as one struct."""
    return F.struct(*KEYS)


def canonical_json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def vector_id(meta: Column, content: Column) -> Column:
    """A chunk's id: a hash of its metadata and content."""
    return F.concat(F.lit("chunk_"), F.sha2(canonical_json(F.struct(meta.alias("metadata"), content.alias("page_content"))), 256))


def restore(text: Column, kind: str) -> Column:
    """Metadata from its JSON copy; what is no object stops the query."""
    parsed = F.from_json(text, kind)
    return F.when(text.rlike("(?s)^\\s*\\{.*\\}\\s*$"), parsed).otherwise(F.raise_error(F.lit("metadata is no JSON object")).cast(kind))


def line_description(ranges: Column, start: Column, end: Column) -> Column:
    line = lambda a, b: F.concat(a.cast("string"), F.lit("-"), b.cast("string"))
    listed = F.array_join(F.transform(ranges, lambda r: line(r["start_line"], r["end_line"])), ", ")
    return F.when(F.coalesce(F.size(ranges), F.lit(0)) > 0, listed).otherwise(F.coalesce(line(start, end), F.lit("unknown")))


def format_ranges(ranges: Column) -> Column:
    one = lambda r: F.when(r["start_line"] == r["end_line"], F.concat(F.lit("L"), r["start_line"])).otherwise(
        F.concat(F.lit("L"), r["start_line"], F.lit("–"), r["end_line"])
    )
    return F.when(F.size(ranges) > 0, F.array_join(F.transform(ranges, one), ", ")).otherwise(F.lit("Range unavailable"))


def server_event(event: Column, data: Column) -> Column:
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def failed_step(progress: Column) -> Column:
    """Index of the pipeline step that failed."""
    found = F.array_position(F.transform(F.array(*map(F.lit, FAILED_STEPS)), lambda t: progress <= t), True)
    return F.when(found == 0, F.lit(len(FAILED_STEPS) - 1)).otherwise(found - 1).cast("int")
