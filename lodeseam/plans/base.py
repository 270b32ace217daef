"""Tables, the chunk view that the queries share, and SQL for the same expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.functions import text as T

QUESTION = "How does the food price filtering work?"
KINDS = ("function", "method", "constructor", "class_context", "markdown_section", "html_document")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of a repository for each source."""
    d = table(spark, sf_dir, "documents")
    end = (F.col("doc_id") % 50 + 1).cast("int")
    return d.select(
        "doc_id",
        F.col("source").alias("repository_id"),
        F.concat(F.col("source"), F.lit("/Doc"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"),
        F.col("lang").alias("language"),
        F.array(*map(F.lit, KINDS))[(F.col("doc_id") % 6).cast("int")].alias("chunk_type"),
        F.when(F.col("doc_id") % 4 != 0, F.regexp_extract("text", "^([A-Za-z]+)", 1)).alias("symbol_name"),
        F.lit(1).alias("symbol_start_line"),
        end.alias("symbol_end_line"),
        F.array(F.struct(F.lit(1).alias("start_line"), end.alias("end_line"))).alias("source_ranges"),
        F.col("text").alias("content"),
    )


CHUNKS = f"""chunks as (select doc_id, source as repository_id, source || '/Doc' || doc_id || '.md' as file_path, lang as language,
  {list(KINDS)!r}[doc_id % 6 + 1] as chunk_type, case when doc_id % 4 <> 0 then regexp_extract(text, '^([A-Za-z]+)', 1) end as symbol_name,
  1 as symbol_start_line, (doc_id % 50 + 1)::int as symbol_end_line, text as content from documents)"""


def sql_list(values) -> str:
    return "([" + ", ".join(f"'{v}'" for v in values) + "]::varchar[])"


_FORMS = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in T.WORD_FORMS.items()) + "}"


def sequence(x: str) -> str:
    spaced = rf"regexp_replace(coalesce({x}, ''), '([a-z0-9])([A-Z])', '\1 \2', 'g')"
    return f"list_transform(regexp_extract_all({spaced}, '[A-Za-z][A-Za-z0-9]*'), lambda w: coalesce({_FORMS}[lower(w)], lower(w)))"


def tokens(x: str) -> str:
    return f"list_distinct({sequence(x)})"


def without(x: str, words) -> str:
    return f"list_filter({x}, lambda t: not list_contains({sql_list(words)}, t))"


def expanded(asked: str) -> str:
    """From tokens without stop words."""
    parts = [f"case when len(list_filter({asked}, lambda t: starts_with(t, '{c}') or starts_with('{c}', t))) > 0 then {sql_list(r)} else {sql_list(())} end" for c, r in T.CONCEPTS.items()]
    return f"list_distinct(flatten([{asked}, {', '.join(parts)}]))"


#: Tokens of the question, and of each chunk.
SCORED = f"""q as (select '{QUESTION}' as question),
q1 as (select question, {tokens("question")} as toks, {without(tokens("question"), T.STOP_WORDS)} as asked from q),
q2 as (select *, {expanded("asked")} as every, {without("asked", T.GENERIC_TERMS)} as focused from q1),
q3 as (select *, {without("every", T.GENERIC_TERMS)} as wanted from q2),
{CHUNKS},
tok as (select chunks.*, {tokens("content")} as ct, {tokens("symbol_name")} as st, {tokens("file_path")} as pt, array_to_string({sequence("symbol_name")}, '') as sym,
  array_to_string({sequence("regexp_extract(file_path, '([^/]*)[.]md$', 1)")}, '') as stem from chunks),
lex as (select tok.*, q3.*, least(1.0, len(list_intersect(wanted, list_distinct(flatten([ct, st, pt])))) / least(6, len(wanted))) as lexical_score,
  case when sym <> '' and list_contains(wanted, sym) then 1.0 when stem <> '' and list_contains(wanted, stem) then 1.0 when len(focused) = 0 then 0.0
    when len(list_intersect(focused, st)) = len(focused) then 1.0 when len(list_intersect(focused, pt)) = len(focused) then 0.9
    else greatest(len(list_intersect(focused, st)) / len(focused), len(list_intersect(focused, pt)) / len(focused) * 0.9) end as exact_match_score,
  list_distinct(flatten([ct, st])) as there from tok cross join q3),
scored as (select *, case when len(list_intersect(st, {sql_list(T.SORT_TERMS)})) > 0 then 0.1
  when chunk_type in ('html_document', 'html_element') then case when list_contains(there, 'price') and list_contains(there, 'range')
    and len(list_intersect(there, ['form', 'input', 'parameter', 'request'])) > 0 then 1.0 else 0.25 end
  when list_contains(there, 'filter') or (list_contains(there, 'price') and list_contains(there, 'range')
    and len(list_intersect(there, ['form', 'input', 'parameter', 'request'])) > 0) then 1.0
  when chunk_type in ('function', 'method') then 0.45 when ends_with(chunk_type, '_context') then 0.35 else 0.25 end as structural_score from lex)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vector_id"), F.col("embedding").cast("array<double>").alias("values"), F.col("label").cast("long").alias("namespace"))


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of the smallest id stands in for an embedded question."""
    return vectors(spark, sf_dir).orderBy("vector_id").first()["values"]


FIRST = "(select arg_min(embedding, vec_id)::double[] from embeddings)"
