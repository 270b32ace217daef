"""Rows that every operator must bear: nulls, empty and long texts, repeats, and columns with names of its own."""

LONG = "lorem ipsum dolor sit amet " * 4000
ODD = [
    (1, "the cat sat on the mat and the dog ran off with the ball today", "en", "a"),
    (2, "the cat sat on the mat and the dog ran off with the ball today", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, " \n\t ", "de", "b"),
    (6, LONG, "en", None),
    (7, "Straße ÄÖÜ naïve 日本語 😀 text", "de", "c"),
    (8, "THE CAT sat on the mat and the dog ran off with the ball today", "en", "a"),
    (8, "THE CAT sat on the mat and the dog ran off with the ball today", "en", "a"),
    (None, "a row without an id", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that operators use inside.
CLASHES = ("node", "fp", "label", "count", "bucket", "part", "key", "n", "words", "removed_lines_", "maybe", "h", "component", "size")


def docs(spark, rows=ODD, clashes=True):
    df = spark.createDataFrame(rows, SCHEMA)
    if clashes:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("x") for c in CLASHES})
    return df


def empty(spark):
    return docs(spark, [])
