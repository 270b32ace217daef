"""Markdown to sections, by one pass over a file's lines inside its row.

The pass knows whether a fence or the front matter is open, which headings the line stands under, and where the section
began and last had text. A chunk is a section, named by its path, with its ancestors' heading lines before its own; what
stands before the first heading, or a file without one, is a document. Files of one path, or without a repository, are
chunked each for itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseam.functions.scan import let, none, once, scan
from lodeseam.operators.structured import COLUMNS, KEY, PIECE, TAG, array_of, bodies, piece

# Markdown's patterns.
ATX = r"^[ \t]{0,3}(#{1,6})(?:[ \t]+(.*?)|[ \t]*)$"
SETEXT = r"^[ \t]{0,3}(=+|-+)[ \t]*$"
FENCE = r"^[ \t]{0,3}(`{3,}|~{3,})"
CLOSED = r"^[ \t]{0,3}(`{3,}|~{3,})[ \t]*$"

HEAD = "struct<level:int,heading:string,line:int,text:string>"
SECTION = f"struct<a:int,line:int,b:int,heads:array<{HEAD}>,first:boolean>"


def _lines(content: Column) -> Column:
    """Lines with the one below, which an underlined heading is told by."""
    found = F.regexp_extract_all(content, F.lit(r"[^\r\n]*+(?:\r\n|\n|\r)|[^\r\n]++$"), F.lit(0))

    def one(rows: Column) -> Column:
        bare = lambda x: F.regexp_replace(x, r"[\r\n]+$", "")
        return F.transform(rows, lambda x, i: F.struct(bare(x).alias("line"), F.coalesce(bare(F.get(rows, i + 1)), F.lit("")).alias("below"), F.octet_length(x).alias("n"), F.octet_length(bare(x)).alias("inner")))

    return let(found, one)


def _walk(content: Column) -> Column:
    """``(state, out)``; the sections but the last."""
    zero = F.struct(F.lit(0).alias("at"), F.lit(1).alias("line"), F.lit("").alias("fence"), F.lit(False).alias("matter"), F.lit(False).alias("under"), none(HEAD).alias("heads"), F.lit(True).alias("first"), F.lit(0).alias("a"), F.lit(1).alias("begun"), F.lit(-1).alias("b"))

    def step(s: Column, x: Column) -> Column:
        line, mark = x["line"], F.regexp_extract(x["line"], FENCE, 1)
        begins_matter = (s["line"] == 1) & line.rlike(r"^---[ \t]*$") & content.rlike(r"[\r\n](---|\.\.\.)[ \t]*([\r\n]|$)")
        ends_matter = s["matter"] & line.rlike(r"^(---|\.\.\.)[ \t]*$")
        matter = begins_matter | (s["matter"] & ~ends_matter)
        closes = (s["fence"] != "") & line.rlike(CLOSED) & mark.startswith(s["fence"])
        hidden = begins_matter | s["matter"] | s["under"] | (s["fence"] != "") | (mark != "")
        fence = F.when(begins_matter | s["matter"], s["fence"]).when(s["fence"] == "", mark).when(closes, F.lit("")).otherwise(s["fence"])
        hashes, under = F.regexp_extract(line, ATX, 1), F.regexp_extract(x["below"], SETEXT, 1)
        setext = (hashes == "") & (under != "") & line.rlike(r"(?U)\S") & ~line.rlike(SETEXT)
        level = F.when(hidden, F.lit(None).cast("int")).when(hashes != "", F.length(hashes)).when(setext, F.when(under.startswith("="), 1).otherwise(2))
        atx = F.regexp_replace(F.regexp_replace(F.regexp_extract(line, ATX, 2), r"[ \t]+#+[ \t]*$", ""), r"^[ \t]+|[ \t]+$", "")
        heading = F.when(hashes != "", atx).otherwise(F.trim(line))
        text = F.when(hashes != "", line).otherwise(F.concat(line, F.lit("\n"), x["below"]))
        head = F.struct(level.alias("level"), heading.alias("heading"), s["line"].alias("line"), text.alias("text"))
        is_head, has_text = level.isNotNull(), line.rlike(r"(?U)\S")
        return F.struct(
            (s["at"] + x["n"]).alias("at"), (s["line"] + 1).alias("line"), fence.alias("fence"), matter.alias("matter"), (is_head & (hashes == "")).alias("under"),
            F.when(is_head, F.concat(F.filter(s["heads"], lambda h: h["level"] < level), F.array(head))).otherwise(s["heads"]).alias("heads"), (s["first"] & ~is_head).alias("first"),
            F.when(is_head, s["at"]).otherwise(s["a"]).alias("a"), F.when(is_head, s["line"]).otherwise(s["begun"]).alias("begun"), F.when(has_text, s["at"] + x["inner"]).when(is_head, -1).otherwise(s["b"]).alias("b"),
        )

    return scan(_lines(content), zero, step, lambda s, x, now: array_of(_section(s), (now["a"] == s["at"]) & (now["begun"] == s["line"]) & ~now["first"] & (s["b"] > s["a"]), SECTION), SECTION)


def _section(s: Column) -> Column:
    return F.struct(s["a"].alias("a"), s["begun"].alias("line"), s["b"].alias("b"), s["heads"].alias("heads"), s["first"].alias("first"))


@once
def _sections() -> Column:
    content = F.col("content")
    return let(_walk(content), lambda r: F.concat(r["out"], array_of(_section(r["state"]), r["state"]["b"] > r["state"]["a"], SECTION)))


def headings(files: DataFrame) -> DataFrame:
    """ATX and setext headings outside fences and front matter: ``(line_no, level, heading)``."""
    found = files.select(*KEY, "language", F.explode(F.filter(_sections(), lambda p: ~p["first"])).alias("p"))
    own = F.element_at("p.heads", -1)
    return found.select(*KEY, "language", own["line"].alias("line_no"), own["level"].alias("level"), own["heading"].alias("heading"))


@once
def _pieces() -> Column:
    content = F.col("content")

    def made(p: Column, body: Column, i: Column, alone: Column) -> Column:
        kind = F.when(~p["first"], F.lit("markdown_section")).when(alone, F.lit("markdown_document")).otherwise(F.lit("markdown_preamble"))
        name = F.when(~p["first"], F.array_join(F.transform(p["heads"], lambda h: h["heading"]), " > "))
        above = F.transform(F.slice(p["heads"], F.lit(1), F.greatest(F.lit(0), F.size(p["heads"]) - 1)), lambda h: F.struct(h["line"].alias("line"), h["text"].alias("text")))
        return piece(kind, name, p["line"], body, F.when(p["first"], none(TAG)).otherwise(above))

    even = lambda text: F.regexp_replace(text, "\r\n?", "\n")
    return let(_sections(), lambda found: bodies(content, found, lambda p, body, i: made(p, body, i, F.size(found) == 1), even))


def markdown(files: DataFrame) -> DataFrame:
    """A row for each section."""
    rows = files.where(F.col("content").rlike(r"(?U)\S")).select(*KEY, "language", F.explode(F.coalesce(_pieces(), none(PIECE))).alias("chunk"))
    return rows.select(*KEY, "language", "chunk.*").select(*COLUMNS)
