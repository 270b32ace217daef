"""Chunking over pages, and over files of every language made of the documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.operators import chunks as C
from lodeseam.operators import structured as S
from lodeseam.operators import windows as W
from lodeseam.operators.markdown import headings, markdown
from lodeseam.plans.base import CHUNKS, chunks, table
from lodeseam.sources import files as Files
from lodeseam.sources.folders import shared

# Source files made of the documents: for each language what its text is in Spark and in the SQL.
_TEXT = "coalesce(text, '')"


def _swap(text: str, *pairs: tuple[str, str]) -> str:
    for a, b in pairs:
        text = f"replace({text}, {a}, {b})"
    return text


BACKSLASH, QUOTE, APOSTROPHE, LINE, CR, TAB = ("chr(92)", "chr(34)", "chr(39)", "chr(10)", "chr(13)", "chr(9)")
ESCAPED = _swap(_TEXT, (BACKSLASH, f"{BACKSLASH} || {BACKSLASH}"), (QUOTE, f"{BACKSLASH} || {QUOTE}"), (LINE, f"{BACKSLASH} || 'n'"), (CR, f"{BACKSLASH} || 'r'"), (TAB, f"{BACKSLASH} || 't'"))
PLAIN = _swap(_TEXT, (BACKSLASH, "''"), (QUOTE, "''"), (APOSTROPHE, "''"), ("'$'", "''"), ("'*'", "''"), (CR, LINE))
MARKED = _swap(_TEXT, ("'&'", "'&amp;'"), ("'<'", "'&lt;'"), ("'>'", "'&gt;'"))
DOUBLED = _swap(_TEXT, (APOSTROPHE, f"{APOSTROPHE} || {APOSTROPHE}"))
ID = "cast(doc_id as string)"

#: Parts of a file, joined in order: a part with a name is a chunk of that kind, one without lies between chunks.
PARTS: dict[str, list[tuple[str | None, str | None, str]]] = {
    "JSON": [
        (None, None, "'{' || chr(10) || '  '"),
        ("json_property", "'id'", f"{QUOTE} || 'id' || {QUOTE} || ': ' || {ID}"),
        (None, None, "', '"),
        ("json_property", "'text'", f"{QUOTE} || 'te' || {BACKSLASH} || 'u0078t' || {QUOTE} || ': ' || {QUOTE} || {ESCAPED} || {QUOTE}"),
        (None, None, "',' || chr(10)"),
        ("json_property", "'tags'", f"{QUOTE} || 'tags' || {QUOTE} || ':' || chr(10) || '[{{}}, [' || {QUOTE} || coalesce(lang, '') || '}},' || {QUOTE} || ']]'".replace("{{", "{").replace("}}", "}")),
        (None, None, "chr(10) || '}'"),
    ],
    "Node Package Configuration": [
        (None, None, "'['"),
        ("json_array_item", "'$[0]'", f"{QUOTE} || {ESCAPED} || {QUOTE}"),
        (None, None, "',' || chr(10)"),
        ("json_array_item", "'$[1]'", f"'{{' || {QUOTE} || 'a' || {QUOTE} || ': [' || {ID} || ', 2]}}'"),
        (None, None, "']'"),
    ],
    "SQL": [
        (None, None, f"'-- a; ' || {ID} || chr(10)"),
        ("sql_insert", "coalesce(source, 'x')", f"'INSERT INTO ' || coalesce(source, 'x') || ' VALUES (' || {APOSTROPHE} || {DOUBLED} || {APOSTROPHE} || ')'"),
        (None, None, "'; /* ; */ '"),
        ("sql_select", None, f"'SELECT ' || {ID}"),
        (None, None, "' -- ;' || chr(10) || ';' || chr(10)"),
        ("sql_create_function", f"'f' || {ID}", f"'CREATE FUNCTION f' || {ID} || '() RETURNS TEXT AS $b$ ; ' || {PLAIN} || '$b$ LANGUAGE SQL'"),
    ],
    "TOML": [
        (None, None, "'# [a]' || chr(10)"),
        ("toml_property", "'id'", f"'id = ' || {ID}"),
        (None, None, "' # b' || chr(10)"),
        ("toml_property", "chr(34) || 'q k' || chr(34)", f"{QUOTE} || 'q k' || {QUOTE} || ' = ' || repeat({QUOTE}, 3) || chr(10) || '[no]' || {PLAIN} || chr(10) || repeat({QUOTE}, 3)"),
        (None, None, "chr(10) || chr(10)"),
        ("toml_table", "'meta.' || coalesce(lang, 'x')", f"'[meta.' || coalesce(lang, 'x') || ']' || chr(10) || 's = [' || {APOSTROPHE} || coalesce(source, '') || {APOSTROPHE} || ',' || chr(10) || ']'"),
        (None, None, "chr(10)"),
        ("toml_table_array", "'rows'", f"'[[rows]]' || chr(10) || 'n = ' || {ID}"),
    ],
    "YAML": [
        (None, None, "'# a' || chr(10)"),
        ("yaml_property", "'id'", f"'id: ' || {ID}"),
        (None, None, "chr(10)"),
        ("yaml_property", "'q k'", f"{QUOTE} || 'q k' || {QUOTE} || ': |' || chr(10) || '  ' || {_swap(PLAIN, (LINE, LINE + " || '  '"))} || chr(10) || '  end'"),
        (None, None, "chr(10) || '# b' || chr(10)"),
        ("yaml_property", "'meta'", "'meta:' || chr(10) || '  lang: ' || coalesce(lang, 'x')"),
    ],
    "CSS": [
        (None, None, f"'/* {{ ; ' || {PLAIN} || ' */' || chr(10)"),
        ("css_rule", "'.' || coalesce(lang, 'x') || ' > .a'", f"'.' || coalesce(lang, 'x') || ' > .a {{ content: ' || {QUOTE} || '}} ' || {_swap(PLAIN, (LINE, "' '"))} || {QUOTE} || '; }}'".replace("{{", "{").replace("}}", "}")),
        (None, None, "' '"),
        ("css_media_query", f"'@media (min-width: ' || {ID} || 'px)'", f"'@media (min-width: ' || {ID} || 'px) {{ a {{ b: c }} }}'"),
        (None, None, "chr(10)"),
        ("css_import", f"'@import ' || {QUOTE} || 'a;b' || {QUOTE}", f"'@import ' || {QUOTE} || 'a;b' || {QUOTE} || ';'"),
    ],
}
#: XML's chunks have the root's start tag before them.
XML_ROOT = f"'<doc id=' || {QUOTE} || {ID} || {QUOTE} || '>'"
PARTS["XML"] = [
    (None, None, f"'<!-- <a> -->' || chr(10) || {XML_ROOT} || chr(10)"),
    ("xml_element", "'doc > text'", f"'<text>' || {MARKED} || '</text>'"),
    (None, None, "chr(10) || 'between'"),
    ("xml_element", "'doc > meta'", f"'<meta a=' || {QUOTE} || '/>' || {QUOTE} || '><b/></meta>'"),
    (None, None, "'</doc>'"),
]


#: Code: what an expected chunk's content is not the whole text of, a class, is said in CODE_SQL.
CODE = {
    "Java": [
        (None, None, f"'package a;' || chr(10) || chr(10) || 'class C' || {ID} || ' {{' || chr(10) || '    String s = ' || {QUOTE} || {ESCAPED} || {QUOTE} || ';' || chr(10) || '    /* {{ ' || {PLAIN} || ' */ '".replace("{{", "{")),
        ("method", f"'run' || {ID}", f"'int run' || {ID} || '(int a,' || chr(10) || '    int b) ' || chr(123) || ' // }}' || chr(10) || '  if (a > b) {{ f(() -> {{ return 1; }}); }}' || chr(10) || '  return ' || {QUOTE} || '}} ' || {ESCAPED} || {QUOTE} || ';' || chr(10) || '  }}'".replace("{{", "{").replace("}}", "}")),
        (None, None, "chr(10) || '}' || chr(10)"),
    ],
    "Python": [
        (None, None, "'import os' || chr(10) || chr(10)"),
        ("function", f"'run_' || {ID}", f"'def run_' || {ID} || '(' || chr(10) || '    a,' || chr(10) || '):' || chr(10) || '    ' || repeat({QUOTE}, 3) || 'def no(): ' || {PLAIN} || repeat({QUOTE}, 3) || chr(10) || '    return a'"),
        (None, None, "chr(10) || chr(10) || '# end' || chr(10) || 'X = 1' || chr(10)"),
    ],
}
_WHOLE = " || ".join(part for _, _, part in CODE["Java"])
CODE_SQL = f"""select {ID} as file_path, 'class_context' as chunk_type, 'C' || {ID} as symbol_name, 3 as symbol_start_line, (len({_WHOLE}) - len(replace({_WHOLE}, chr(10), '')))::int as symbol_end_line,
  md5('class C' || {ID} || chr(10) || chr(10) || 'String s = ' || {QUOTE} || {ESCAPED} || {QUOTE}) as content_md5 from documents"""


def made_files(s, d, language: str, where: str = "true"):
    """Every document that ``where`` lets pass as one file of the language."""
    text = " || ".join(part for _, _, part in (PARTS | CODE)[language])
    return table(s, d, "documents").where(where).selectExpr("source as repository_id", f"{ID} as file_path", f"'{language}' as language", f"{text} as content")


def expected(language: str, where: str = "true") -> str:
    """SQL for the chunks of ``made_files``: what the parts say, their lines counted from those before them."""
    rows, before = [], "''"
    for kind, name, part in (PARTS | CODE)[language]:
        if kind:
            line = f"1 + len({before}) - len(replace({before}, chr(10), ''))"
            own = f"{line} + len({part}) - len(replace({part}, chr(10), ''))"
            content = f"{XML_ROOT} || chr(10) || chr(10) || {part}" if language == "XML" else part
            rows.append(f"select {ID} as file_path, '{kind}' as chunk_type, {name or 'null::varchar'} as symbol_name, ({line})::int as symbol_start_line, ({own})::int as symbol_end_line, md5({content}) as content_md5 from documents where {where}")
        before = f"{before} || {part}"
    return " union all ".join(rows)


def cut(df):
    return df.select("file_path", "chunk_type", "symbol_name", "symbol_start_line", "symbol_end_line", F.md5("content").alias("content_md5"))


def all_files(s, d):
    """The documents dealt out to all languages that can be made of them."""
    return reduce(DataFrame.unionByName, [made_files(s, d, language, f"doc_id % {len(PARTS)} = {i}") for i, language in enumerate(PARTS)])


def pages(s, d):
    return table(s, d, "pages").select(F.lit("repo_00000000").alias("repository_id"), F.col("page_id").cast("string").alias("file_path"), F.lit("HTML").alias("language"), F.col("html").alias("content"))


#: The pages' own shape: what stands below html and below body, by patterns. A page with a sign that HTML's text can't hold
#: is whole.
HTML_SQL = r"""with p as (select page_id::varchar as file_path, html, regexp_extract(html, '<html[^>]*>') as h,
  regexp_extract_all(html, '(?s)<head>.*?</head>|<nav>.*?</nav>|<div class="ad">.*?</div>|<article>.*?</article>|<footer>.*?</footer>') as parts from pages),
e as (select file_path, html, h, unnest(parts) as part from p),
l as (select *, (1 + len(before) - len(replace(before, chr(10), '')))::int as line from (select *, substr(html, 1, position(part in html) - 1) as before from e))
select file_path, 'html_element' as chunk_type, 'html > ' || case when starts_with(part, '<head') then 'head' else 'body > ' || case when starts_with(part, '<div') then 'div.ad' else regexp_extract(part, '^<([a-z]+)', 1) end end as symbol_name,
  line as symbol_start_line, (line + len(part) - len(replace(part, chr(10), '')))::int as symbol_end_line,
  md5(h || chr(10) || chr(10) || case when starts_with(part, '<head') then '' else '<body>' || chr(10) || chr(10) end || part) as content_md5 from l"""


def marked_documents(s, d):
    """Documents in which a line of one short sentence is a heading, its level by the number of its words."""
    text = F.regexp_replace(F.regexp_replace("text", r"(?m)^([A-Z][a-z]+\.)$", "# $1"), r"(?m)^([A-Z][a-z]+ [a-z]+\.)$", "## $1")
    return table(s, d, "documents").select(F.col("source").alias("repository_id"), F.col("doc_id").cast("string").alias("file_path"), F.lit("Markdown").alias("language"), text.alias("content"))


def shown(df):
    return df.select("file_path", "chunk_type", "symbol_name", "symbol_start_line", "symbol_end_line", F.to_json("source_ranges").alias("ranges"), F.md5("content").alias("content_md5"))


#: A file for each document: two languages, a picture, a file of a folder that is left out, a Dockerfile, and no known language.
FILE_PATH = "'src/' || case doc_id % 6 when 0 then 'a/' || doc_id || '.py' when 1 then '.hidden/' || doc_id || '.md' when 2 then doc_id || '.png' when 3 then 'node_modules/' || doc_id || '.py' when 4 then doc_id || '/Dockerfile' else doc_id || '.txt' end"


def folder_of_documents(s, d) -> str:
    root = shared(s, "files").removeprefix("file://")
    Files.write_files(table(s, d, "documents").selectExpr(f"{FILE_PATH} as relative_path", "encode(coalesce(text, ''), 'UTF-8') as data"), root)
    return root


QUERIES = {
    "scan_files": (
        lambda s, d: Files.scan(s, folder_of_documents(s, d), "repo_00000000")[0].select("relative_path", "language", "size_bytes", F.md5("content").alias("content_md5")),
        f"""with f as (select {FILE_PATH} as relative_path, doc_id % 6 as k, coalesce(text, '') as text from documents)
        select relative_path, case k when 0 then 'Python' when 1 then 'Markdown' when 4 then 'Dockerfile' end as language, octet_length(encode(text)) as size_bytes,
          md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) as content_md5 from f where k in (0, 1, 4) and regexp_matches(text, '[^ \\t\\n\\r]') and octet_length(encode(text)) <= 1000000""",
    ),
    "decode_text": (
        lambda s, d: table(s, d, "documents").select("doc_id", Files.decoded(F.when(F.col("doc_id") % 2 == 0, F.encode(F.replace("text", F.lit("\n"), F.lit("\r\n")), "UTF-8")).otherwise(F.encode(F.regexp_replace("text", "[^\\x{0}-\\x{ff}]", "?"), "ISO-8859-1"))).alias("text")).select("doc_id", F.md5("text").alias("text_md5")),
        r"""with t as (select doc_id, case when doc_id % 2 = 0 then replace(text, chr(10), chr(13) || chr(10)) else regexp_replace(text, '[^\x{0}-\x{ff}]', '?', 'g') end as text from documents)
        select doc_id, md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) as text_md5 from t""",
    ),
    "chunk_cohesive": (
        lambda s, d: C.cohesive(table(s, d, "documents").select(F.col("source").alias("repository_id"), F.col("doc_id").cast("string").alias("file_path"), F.lit("Makefile").alias("language"), F.col("text").alias("content"))).select("file_path", "chunk_type", "symbol_end_line"),
        "select doc_id::varchar as file_path, 'makefile' as chunk_type, len(string_split(regexp_replace(text, '\\n$', ''), chr(10)))::int as symbol_end_line from documents where regexp_matches(text, '[^ \\t\\n\\r]')",
    ),
    "markdown_headings": (
        lambda s, d: headings(marked_documents(s, d)).groupBy("file_path").agg(F.count(F.lit(1)).alias("headings"), F.sum("level").cast("long").alias("levels")),
        """with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents),
        h as (select doc_id, case when regexp_matches(line, '^[A-Z][a-z]+[.]$') then 1 when regexp_matches(line, '^[A-Z][a-z]+ [a-z]+[.]$') then 2 end as level from l)
        select doc_id::varchar as file_path, count(*) as headings, sum(level)::bigint as levels from h where level is not null group by doc_id""",
    ),
    "chunk_markdown": (lambda s, d: shown(markdown(marked_documents(s, d))), None),
    "chunk_code": (lambda s, d: cut(C.declarations(made_files(s, d, "Java").unionByName(made_files(s, d, "Python")))), " union all ".join((CODE_SQL, expected("Java"), expected("Python")))),
    "chunk_json": (lambda s, d: cut(S.json(made_files(s, d, "JSON")).unionByName(S.json(made_files(s, d, "Node Package Configuration")))), f"{expected('JSON')} union all {expected('Node Package Configuration')}"),
    "chunk_sql": (lambda s, d: cut(S.sql(made_files(s, d, "SQL"))), expected("SQL")),
    "chunk_toml": (lambda s, d: cut(S.toml(made_files(s, d, "TOML"))), expected("TOML")),
    "chunk_yaml": (lambda s, d: cut(S.yaml(made_files(s, d, "YAML"))), expected("YAML")),
    "chunk_css": (lambda s, d: cut(S.stylesheet(made_files(s, d, "CSS"))), expected("CSS")),
    "chunk_xml": (lambda s, d: cut(S.xml(made_files(s, d, "XML"))), expected("XML")),
    "chunk_json_events": (
        lambda s, d: S.json(table(s, d, "events").select(F.lit("r").alias("repository_id"), F.col("event_id").cast("string").alias("file_path"), F.lit("JSON").alias("language"), F.col("props").alias("content"))).select("file_path", "symbol_name", "content"),
        """select event_id::varchar as file_path, k as symbol_name, '"' || k || '": ' || json_extract_string(props, k) as content from (select event_id, props, unnest(json_keys(props)) as k from events)""",
    ),
    "chunk_router": (
        lambda s, d: C.route(all_files(s, d)).groupBy("language", "chunk_type").agg(F.count(F.lit(1)).alias("chunks"), F.sum("symbol_start_line").cast("long").alias("starts"), F.sum("symbol_end_line").cast("long").alias("ends")),
        " union all ".join(f"select '{language}' as language, chunk_type, count(*) as chunks, sum(symbol_start_line)::bigint as starts, sum(symbol_end_line)::bigint as ends from ({expected(language, f'doc_id % {len(PARTS)} = {i}')}) group by chunk_type" for i, language in enumerate(PARTS)),
    ),
    "chunk_router_windows": (lambda s, d: W.split(C.route(all_files(s, d))).select("file_path", "language", "chunk_type", "part", F.length("content").cast("long").alias("n_chars"), F.md5("content").alias("content_md5")), None),
    "chunk_html": (lambda s, d: cut(S.html(pages(s, d))), HTML_SQL),
    "html_descriptor": (
        lambda s, d: pages(s, d).select(F.explode(F.regexp_extract_all("content", F.lit(r"(?i)<(?:header|main|section|article|nav|footer|aside|script|style|div|form|table)\b[^>]*>"), 0)).alias("tag")).groupBy(S.descriptor(F.col("tag")).alias("symbol_name")).agg(F.count(F.lit(1)).alias("n")),
        r"""with e as (select unnest(regexp_extract_all(html, '(?i)<(?:header|main|section|article|nav|footer|aside|script|style|div|form|table)\b[^>]*>')) as tag from pages),
        p as (select regexp_extract(tag, '^<\s*([A-Za-z][A-Za-z0-9-]*)', 1) as name, trim(regexp_extract(tag, '(?i)\sid\s*=\s*["'']([^"'']*)["'']', 1)) as id,
          list_filter(string_split_regex(regexp_extract(tag, '(?i)\sclass\s*=\s*["'']([^"'']*)["'']', 1), '\s+'), lambda x: x <> '') as classes from e)
        select name || case when id <> '' then '#' || id else '' end || array_to_string(list_transform(classes, lambda c: '.' || c), '') as symbol_name, count(*) as n from p group by 1""",
    ),
    "chunk_dedupe": (
        lambda s, d: C.dedupe(chunks(s, d).withColumn("place", F.col("doc_id")).unionByName(chunks(s, d).withColumn("place", F.col("doc_id") + 1_000_000_000)), "place").select("doc_id", "place"),
        "select doc_id, doc_id as place from documents",
    ),
    "to_documents": (
        lambda s, d: C.to_documents(chunks(s, d)).select("metadata.file_path", "metadata.symbol_end_line", F.md5("page_content").alias("content_md5")),
        f"with {CHUNKS} select file_path, symbol_end_line, md5(content) as content_md5 from chunks",
    ),
    "chunk_windows": (lambda s, d: W.split(chunks(s, d)).select("doc_id", "part", F.length("content").cast("long").alias("n_chars"), F.md5("content").alias("content_md5")), None),
    "group_source_lines": (
        lambda s, d: C.ranges_of_lines(table(s, d, "lineitem").where("l_quantity > 10"), ("l_orderkey",), "l_linenumber"),
        """with x as (select distinct l_orderkey, l_linenumber from lineitem where l_quantity > 10), r as (select *, l_linenumber - row_number() over (partition by l_orderkey order by l_linenumber) as run from x)
        select l_orderkey, min(l_linenumber) as start_line, max(l_linenumber) as end_line from r group by l_orderkey, run""",
    ),
}
