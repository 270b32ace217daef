"""Text functions over documents, pages, benchmark and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeseam.functions import metadata as M
from lodeseam.functions import paths as P
from lodeseam.functions import text as T
from lodeseam.plans.base import CHUNKS, SCORED, chunks, expanded, sql_list, table, tokens, without

asked = f"""a as (select item_id, text, {tokens("text")} as toks, {without(tokens("text"), T.STOP_WORDS)} as asked from benchmark),
e as (select *, {expanded("asked")} as every from a)"""
line = lambda c: F.array_join(F.sort_array(c), " ")
q = lambda: F.lit("How does the food price filtering work?")
PATHS = ("src/main/App.java", "node_modules/x/index.js", "build", "build/out.py", "docs/.env", "img/logo.PNG", "Dockerfile", "a/package-lock.json", "x/pyproject.toml", "README", "lib/a.b.ts", "web/login.jsp")


def path_rows(spark, sf_dir):
    """Paths made of pages' ids and a fixed list of endings."""
    ending = F.array(*map(F.lit, PATHS))[(F.col("page_id") % len(PATHS)).cast("int")]
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit("/"), ending).alias("path"))


PATH_SQL = f"""p as (select page_id, 'p' || page_id || '/' || {sql_list(PATHS)}[page_id % {len(PATHS)} + 1] as path from pages),
s as (select *, string_split(path, '/') as parts, string_split(path, '/')[-1] as name, lower(regexp_extract(string_split(path, '/')[-1], '.([.][^.]+)$', 1)) as ext from p)"""
_map = lambda m: "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in m.items()) + "}"

QUERIES = {
    "tokenize": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.size(T.tokens("text")).cast("long").alias("n_tokens"), F.md5(line(T.tokens("text"))).alias("tokens_md5")),
        f"select doc_id, len(t) as n_tokens, md5(array_to_string(list_sort(t), ' ')) as tokens_md5 from (select doc_id, {tokens('text')} as t from documents)",
    ),
    "query_terms": (
        lambda s, d: table(s, d, "benchmark").select("item_id", line(T.focused_terms("text")).alias("terms")),
        f"select item_id, array_to_string(list_sort({without(tokens('text'), T.STOP_WORDS + T.GENERIC_TERMS)}), ' ') as terms from benchmark",
    ),
    "expand_terms": (
        lambda s, d: table(s, d, "benchmark").select("item_id", line(T.expanded_terms("text")).alias("terms")),
        f"with {asked} select item_id, array_to_string(list_sort(every), ' ') as terms from e",
    ),
    "query_text": (
        lambda s, d: table(s, d, "benchmark").select("item_id", T.instructed(T.query_text("text")).alias("query_text")),
        f"""with {asked}, x as (select item_id, trim(text, ' ' || chr(10) || chr(9) || chr(13)) as bare, list_filter(every, lambda t: not list_contains(toks, t)) as added from e)
        select item_id, 'Instruct: {T.QUERY_INSTRUCTION}' || chr(10) || 'Query: ' || case when len(added) = 0 then bare else 'Question: ' || bare || chr(10)
          || 'Related software-repository concepts: ' || array_to_string(list_sort(added), ', ') end as query_text from x""",
    ),
    "document_text": (
        lambda s, d: chunks(s, d).select("doc_id", F.sha2(T.document_text("file_path", "language", "chunk_type", "symbol_name", "symbol_start_line", "symbol_end_line", "content"), 256).alias("text_sha256")),
        f"""with {CHUNKS} select doc_id, sha256('Software repository source chunk' || chr(10) || 'File: ' || file_path || chr(10) || 'Language: ' || coalesce(language, '') || chr(10)
          || 'Chunk type: ' || chunk_type || chr(10) || 'Symbol: ' || coalesce(nullif(symbol_name, ''), '(file or structural context)') || chr(10) || 'Symbol lines: ' || symbol_start_line
          || '-' || symbol_end_line || chr(10) || 'Source:' || chr(10) || coalesce(content, '')) as text_sha256 from chunks""",
    ),
    "lexical_score": (
        lambda s, d: chunks(s, d).select("doc_id", F.round(T.lexical_score(q(), "content", "symbol_name", "file_path"), 6).alias("lexical_score")),
        f"with {SCORED} select doc_id, round(lexical_score, 6) as lexical_score from lex",
    ),
    "exact_score": (
        lambda s, d: chunks(s, d).select("doc_id", F.round(T.exact_score(q(), "symbol_name", "file_path"), 6).alias("exact_match_score")),
        f"with {SCORED} select doc_id, round(exact_match_score, 6)::double as exact_match_score from lex",
    ),
    "filter_structural_score": (
        lambda s, d: chunks(s, d).select("doc_id", T.filter_structural_score("chunk_type", "symbol_name", "content").alias("structural_score")),
        f"with {SCORED} select doc_id, structural_score::double as structural_score from scored",
    ),
    "structural_score": (
        lambda s, d: chunks(s, d).select("doc_id", T.structural_score(F.lit("How is Order queue implemented?"), "chunk_type", "symbol_name", "content").alias("structural_score")),
        f"""with {CHUNKS}, l as (select *, len(list_filter(string_split(content, chr(10)), lambda x: trim(x, ' ' || chr(9)) <> '')) as n from chunks)
        select doc_id, (case when chunk_type in ('function', 'method') then case when regexp_matches(lower(coalesce(symbol_name, '')), '^(size$|get|has|is|set)') and n <= 5
          and not regexp_matches(content, '\\b(if|for|while|switch|try)\\b') then 0.25 else 1.0 end when chunk_type = 'constructor' then 0.75
          when chunk_type = 'class_context' then 0.55 when chunk_type = 'markdown_section' then 0.25 else 0.5 end)::double as structural_score from l""",
    ),
    "trivial_accessor": (
        lambda s, d: chunks(s, d).select("doc_id", T.trivial_accessor("symbol_name", "content").alias("trivial")),
        f"""with {CHUNKS} select doc_id, regexp_matches(lower(coalesce(symbol_name, '')), '^(size$|get|has|is|set)')
          and len(list_filter(string_split(content, chr(10)), lambda x: trim(x, ' ' || chr(9)) <> '')) <= 5 and not regexp_matches(content, '\\b(if|for|while|switch|try)\\b') as trivial from chunks""",
    ),
    "file_stem": (
        lambda s, d: path_rows(s, d).select("page_id", T.file_stem("path").alias("stem")),
        f"with {PATH_SQL} select page_id, case when ends_with(name, '.') then name else regexp_replace(name, '(.)[.][^.]*$', '\\1') end as stem from s",
    ),
    "path_ignore": (
        lambda s, d: path_rows(s, d).select("page_id", P.ignored(F.col("path")).alias("ignored")),
        f"""with {PATH_SQL} select page_id, len(list_intersect(parts[1:-2], {sql_list(P.IGNORED_FOLDERS)})) > 0 or list_contains({sql_list(P.IGNORED_NAMES)}, name)
          or list_contains({sql_list(P.IGNORED_SUFFIXES)}, ext) as ignored from s""",
    ),
    "detect_language": (
        lambda s, d: path_rows(s, d).select("page_id", P.language(F.col("path")).alias("language")),
        f"with {PATH_SQL} select page_id, coalesce({_map(P.LANGUAGE_OF_NAME)}[name], {_map(P.LANGUAGE_OF_SUFFIX)}[ext]) as language from s",
    ),
    "supports_chunking": (
        lambda s, d: path_rows(s, d).select("page_id", P.supports_chunking(P.language(F.col("path"))).alias("supported")),
        f"""with {PATH_SQL}, l as (select page_id, coalesce({_map(P.LANGUAGE_OF_NAME)}[name], {_map(P.LANGUAGE_OF_SUFFIX)}[ext]) as language from s)
        select page_id, coalesce(list_contains({sql_list(P.CODE_LANGUAGES + P.STRUCTURED_LANGUAGES)}, language), false) as supported from l""",
    ),
    "url_parse": (
        lambda s, d: table(s, d, "pages").select("page_id", P.repository_of(F.col("url")).alias("r")).select("page_id", "r.url", "r.owner", "r.name"),
        """with u as (select page_id, rtrim(url, '/') as url from pages),
        p as (select *, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') as parts from u)
        select page_id, url, parts[1] as owner, regexp_replace(parts[2], '[.][gG][iI][tT]$', '') as name from p""",
    ),
    "url_validate": (
        lambda s, d: table(s, d, "pages").select("page_id", P.repository_url_valid(F.regexp_replace("url", "//[^/]*example[.]org", "//github.com")).alias("valid")),
        """with u as (select page_id, regexp_replace(url, '//[^/]*example[.]org', '//github.com') as url from pages)
        select page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) in ('github.com', 'www.github.com')
          and len(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')) = 2 as valid from u""",
    ),
    "id_validate": (
        lambda s, d: table(s, d, "pages").select("page_id", P.id_valid(F.concat(F.lit("repo_"), F.substring(F.md5("url"), 1, 8)), "repo").alias("good"), P.id_valid(F.col("url"), "chat").alias("bad")),
        "select page_id, regexp_matches('repo_' || substr(md5(url), 1, 8), '^repo_[a-f0-9]{8}$') as good, regexp_matches(url, '^chat_[a-f0-9]{8}$') as bad from pages",
    ),
    "jaccard_pairs": (
        # each turn of a conversation and the one before it
        lambda s, d: table(s, d, "conversations").withColumn("words", T.word_set("text")).withColumn("before", F.lag("words").over(Window.partitionBy("conv_id").orderBy("turn", "text")))
        .where("before is not null").select("conv_id", "turn", F.round(T.jaccard(F.col("words"), F.col("before")), 6).alias("similarity")),
        """with w as (select conv_id, turn, list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '')) as words, text from conversations),
        b as (select *, lag(words) over (partition by conv_id order by turn, text) as before from w)
        select conv_id, turn, round(case when len(words) + len(before) = 0 then 0 else len(list_intersect(words, before)) / (len(words) + len(before) - len(list_intersect(words, before))) end, 6) as similarity
        from b where before is not null""",
    ),
    "vector_id": (
        lambda s, d: chunks(s, d).select("doc_id", M.vector_id(M.metadata(), F.col("content")).alias("vector_id")),
        f"""with {CHUNKS} select doc_id, 'chunk_' || sha256('{{"metadata":{{"chunk_type":"' || chunk_type || '","file_path":"' || file_path || '","language":' || coalesce(to_json(language)::varchar, 'null')
          || ',"repository_id":"' || repository_id || '","source_ranges":[{{"start_line":1,"end_line":' || symbol_end_line || '}}],"symbol_end_line":' || symbol_end_line || ',"symbol_name":'
          || coalesce(to_json(symbol_name)::varchar, 'null') || ',"symbol_start_line":1}},"page_content":' || to_json(content)::varchar || '}}') as vector_id from chunks""",
    ),
    "metadata_flatten": (
        lambda s, d: chunks(s, d).select("doc_id", *M.FLAT, F.md5(M.canonical_json(M.metadata())).alias("json_md5")),
        f"""with {CHUNKS} select doc_id, chunk_type, file_path, language, repository_id, symbol_end_line, symbol_name, symbol_start_line,
          md5('{{"chunk_type":"' || chunk_type || '","file_path":"' || file_path || '","language":' || coalesce(to_json(language)::varchar, 'null') || ',"repository_id":"' || repository_id
          || '","source_ranges":[{{"start_line":1,"end_line":' || symbol_end_line || '}}],"symbol_end_line":' || symbol_end_line || ',"symbol_name":' || coalesce(to_json(symbol_name)::varchar, 'null')
          || ',"symbol_start_line":1}}') as json_md5 from chunks""",
    ),
    "metadata_restore": (
        lambda s, d: table(s, d, "events").select("event_id", M.restore(F.col("props"), "struct<k:bigint>").alias("m")).select("event_id", "m.k"),
        "select event_id, (props->>'$.k')::bigint as k from events",
    ),
    "json_props": (
        lambda s, d: table(s, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value")),
        "select event_id, unnest(json_keys(props)) as key, props->>('$.' || unnest(json_keys(props))) as value from events",
    ),
    "line_description": (
        lambda s, d: chunks(s, d).select("doc_id", M.line_description(F.when(F.col("doc_id") % 3 == 0, F.col("source_ranges")), F.when(F.col("doc_id") % 3 == 1, F.col("symbol_start_line")), F.col("symbol_end_line")).alias("lines")),
        f"with {CHUNKS} select doc_id, case doc_id % 3 when 2 then 'unknown' else '1-' || symbol_end_line end as lines from chunks",
    ),
    "format_ranges": (
        lambda s, d: chunks(s, d).select("doc_id", M.format_ranges(F.col("source_ranges")).alias("ranges")),
        f"with {CHUNKS} select doc_id, case when symbol_end_line = 1 then 'L1' else 'L1–' || symbol_end_line end as ranges from chunks",
    ),
    "line_mapping": (
        # the source line of each line of a chunk that has as many lines as its ranges
        lambda s, d: chunks(s, d).select("doc_id", F.posexplode(F.flatten(F.transform("source_ranges", lambda r: F.sequence(r["start_line"], r["end_line"])))).alias("at", "source_line"), F.size(F.split("content", "\n")).alias("n"), "symbol_end_line")
        .where("n = symbol_end_line").select("doc_id", F.col("at").cast("long").alias("place"), "source_line"),
        f"""with {CHUNKS}, m as (select doc_id, unnest(range(symbol_end_line)) as place from chunks where len(string_split(content, chr(10))) = symbol_end_line)
        select doc_id, place, (place + 1)::int as source_line from m""",
    ),
    "sse_format": (
        lambda s, d: table(s, d, "events").select("event_id", M.server_event(F.col("event_type"), F.to_json(F.struct("user_id"))).alias("message")),
        "select event_id, 'event: ' || event_type || chr(10) || 'data: {\"user_id\":' || user_id || '}' || chr(10) || chr(10) as message from events",
    ),
}
