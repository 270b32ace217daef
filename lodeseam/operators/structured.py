"""JSON, SQL, stylesheets, TOML, YAML, XML and HTML to chunks, by a pass over a file's lexemes inside its row.

A pattern cuts the text into lexemes that cover it; a string or a comment that ends is one. ``functions.scan`` walks them with a small state: what is open (a
string, a comment, a dollar-quoted body), how deep the brackets are, or which elements are open. What stands in a string
or a comment therefore separates nothing. Pieces are places in the text's bytes; their texts, names, types and lines are
columns. Nothing is shuffled, no file leaves its row, and the cost of a file grows with its lexemes times about their
root.

A file without text gives no chunk; one that gives no piece, or is not well-formed where the format says so, stays whole
as one chunk. Null texts give none. ``source_ranges`` are the lines of the context first, then of the piece. Rows that
repeat a path are chunked each for itself.

Known limits: procedural SQL between BEGIN and END without dollar quotes is cut at its semicolons; a YAML root in flow style is
one document, and YAML is judged by its top-level lines alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseam.functions.scan import let, none, once, scan

KEY = ("repository_id", "file_path")
COLUMNS = ("repository_id", "file_path", "language", "chunk_type", "symbol_name", "symbol_start_line", "symbol_end_line", "source_ranges", "content")
SPAN = "struct<a:int,line:int,b:int>"
RANGE = "struct<start_line:int,end_line:int>"

# Kinds of statement by how they begin, and where a statement has its name.
STATEMENTS = (
    ("sql_create_table", r"(?is)^create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?table\b"),
    ("sql_create_view", r"(?is)^create\s+(?:or\s+replace\s+)?view\b"),
    ("sql_create_function", r"(?is)^create\s+(?:or\s+replace\s+)?function\b"),
    ("sql_create_procedure", r"(?is)^create\s+(?:or\s+replace\s+)?procedure\b"),
    ("sql_alter_table", r"(?is)^alter\s+table\b"),
    ("sql_drop_table", r"(?is)^drop\s+table\b"),
    ("sql_insert", r"(?is)^insert\b"),
    ("sql_update", r"(?is)^update\b"),
    ("sql_delete", r"(?is)^delete\b"),
    ("sql_select", r"(?is)^(?:select|with)\b"),
)
SQL_NAME = (
    r"(?is)^(?:create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:table|view|function|procedure)|alter\s+table|drop\s+table|insert\s+into|update|delete\s+from)"
    r"\s+(?:if\s+(?:not\s+)?exists\s+)?((?:\"[^\"]*\"|`[^`]*`|[^\s(;\"`])+)"
)
# Elements without an end, and which open elements a start tag ends.
VOID = "area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source track wbr".split()
NO_PARAGRAPH = "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section".split()
ENDS = {"li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "tr": ["tr", "td", "th"], "td": ["td", "th"], "th": ["td", "th"], "optgroup": ["optgroup"]} | {x: ["p"] for x in NO_PARAGRAPH}

# Strings and comments that end are one lexeme each, before all else; one that doesn't is told by its opening sign.
_DOUBLE, _SINGLE, _BLOCK = r""""(?:[^"\\]++|\\.)*+"|""", r"""'(?:[^'\\]++|\\.)*+'|""", r"/\*.*?\*/|"
_IN_SCSS = r"""(?:[^%s\\#]++|\\.|#\{[^{}]*+\}|#)*+"""
LEXEMES = {
    "json": r"(?s)" + _DOUBLE + r"//[^\n]*+|" + _BLOCK + r"""\\.|["{}\[\],\n]|//|/\*|\*/|[^\\"{}\[\],/*\n]+|.""",
    "sql": r"""(?s)"[^"]*+"|'[^']*+'|`[^`]*+`|--[^\n]*+|/\*.*?\*/|(\$\w*+\$).*?\1|--|/\*|\*/|\$\w*\$|['"`;\n]|[^\-/*$'"`;\n]+|.""",
    "css": r"(?s)" + f'"{_IN_SCSS % chr(34)}"|' + f"'{_IN_SCSS % chr(39)}'|" + _BLOCK + r"""\\.|#\{[^{}]*\}|url\([^)"'\n]*\)|/\*|\*/|//|["'{}();\n]|(?:[^\\#/*"'{}();\nu]|u(?!rl\())++|.""",
    "toml": r'''(?s)"""(?:[^"\\]++|\\.|"(?!""))*+"""|\'\'\'.*?\'\'\'|"(?!"")(?:[^"\\]++|\\.)*+"|'(?!\'\')[^']*+'|#[^\n]*+|"""|\'\'\'|\\.|["'{}\[\]#\n]|[^\\"'{}\[\]#\n]+|.''',
    "xml": r"""(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!DOCTYPE[^>\[]*(?:\[.*?\])?[^>]*>|</?[A-Za-z_:][^\s/>]*(?:[^>"']|"[^"]*"|'[^']*')*+>|[^<]+|<""",
    "html": r"""(?is)<!--.*?-->|<![^>]*>|<(script|style)\b[^>]*>.*?</\1\s*>|</?[A-Za-z][^\s/>]*(?:[^>"']|"[^"]*"|'[^']*')*+>|[^<]+|<""",
}


LEXEMES["scss"] = LEXEMES["css"].replace("(?s)", r"(?s)//[^\n]*+|", 1)


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s++|\s++$", "")


def array_of(value: Column, when: Column, kind: str) -> Column:
    return F.when(when, F.array(value)).otherwise(none(kind))


# brackets, strings and comments


def lexed(content: Column, language: str, closers: dict[str, str], comments: tuple[str, ...] = (), opens: str = "", shuts: str = "", separators: str = "") -> Column:
    """Lexemes with what each of them would open, close or separate where nothing is open."""

    def one(x: Column) -> Column:
        closer = F.lit("")
        for begin, end in closers.items():
            closer = F.when(x == begin, F.lit(end)).otherwise(closer)
        if language == "sql":
            closer = F.when(x.rlike(r"^\$\w*\$$"), x).otherwise(closer)
        return F.struct(
            x.alias("lex"), F.octet_length(x).alias("n"), newlines(x).alias("nl"), (~x.rlike(r"(?U)\S")).alias("blank"), closer.alias("closer"), reduce(or_, [x.startswith(c) for c in comments], F.lit(False)).alias("comment"),
            F.when(x.isin(*opens), 1).when(x.isin(*shuts), -1).otherwise(0).alias("step") if opens else F.lit(0).alias("step"), x.isin(*separators).alias("separates"),
        )

    return F.transform(F.regexp_extract_all(content, F.lit(LEXEMES[language]), F.lit(0)), one)


def separated(items: Column, depth: int, inclusive: bool, shut: str, raw: bool = False) -> Column:
    """``(good, out)``: the spans between separators at a depth of brackets, blanks and comments at their ends left out.
    ``shut`` ends a piece too: inside the brackets it closes, or with it where ``inclusive``. ``raw``: a backslash does not
    keep a single quote from ending its string. Good is a text that ends with nothing open."""
    zero = F.struct(F.lit(0).alias("at"), F.lit(1).alias("line"), F.lit("").alias("open"), F.lit(False).alias("comment"), F.lit(0).alias("depth"), F.lit(False).alias("cut"), F.lit(-1).alias("a"), F.lit(0).alias("begun"), F.lit(0).alias("b"), F.lit(True).alias("good"))

    def step(s: Column, x: Column) -> Column:
        quiet = s["open"] == ""
        closes = (s["open"] == x["lex"]) | ((s["open"] == "'") & (x["lex"] == "\\'") if raw else F.lit(False))
        comment = F.when(quiet, x["comment"]).otherwise(s["comment"])
        live = (quiet & (x["closer"] == "")) | ((s["open"] == "\n") & (x["lex"] == "\n"))
        cut = live & ((x["separates"] & (s["depth"] == depth)) | ((x["lex"] == shut) & (s["depth"] == depth + int(inclusive))))
        member = ~comment & (~quiet | ~x["blank"]) & (s["depth"] >= depth) & (F.lit(inclusive) | ~cut)
        before = F.when(s["cut"], -1).otherwise(s["a"])
        begins = (before < 0) & member
        moved = s["depth"] + F.when(live, x["step"]).otherwise(0)
        return F.struct(
            (s["at"] + x["n"]).alias("at"), (s["line"] + x["nl"]).alias("line"), F.when(quiet, x["closer"]).when(closes, F.lit("")).otherwise(s["open"]).alias("open"), comment.alias("comment"), moved.alias("depth"), cut.alias("cut"),
            F.when(begins, s["at"]).otherwise(before).alias("a"), F.when(begins, s["line"]).otherwise(s["begun"]).alias("begun"), F.when(member, s["at"] + x["n"]).otherwise(s["b"]).alias("b"), (s["good"] & (moved >= 0)).alias("good"),
        )

    span = lambda s: F.struct(s["a"].alias("a"), s["begun"].alias("line"), s["b"].alias("b"))
    walked = scan(items, zero, step, lambda s, x, now: array_of(span(now), now["cut"] & (now["a"] >= 0), SPAN), SPAN)

    def last(r: Column) -> Column:
        s = r["state"]
        good = s["good"] & (s["depth"] == 0) & ((s["open"] == "") | (s["open"] == "\n"))
        return F.struct(good.alias("good"), F.concat(r["out"], array_of(span(s), ~s["cut"] & (s["a"] >= 0), SPAN)).alias("out"))

    return let(walked, last)


# chunks


def piece(kind: Column, name: Column, line: Column, body: Column, context: Column | None = None) -> Column:
    """A chunk as a struct. ``context`` are ``(line, text)`` whose texts stand before the piece's own."""
    span = lambda line, text: F.struct(line.cast("int").alias("start_line"), (line + newlines(text)).cast("int").alias("end_line"))
    own = F.array(span(line, body))
    ranges = own if context is None else F.array_distinct(F.concat(F.transform(context, lambda c: span(c["line"], c["text"])), own))
    content = body if context is None else F.array_join(F.concat(F.transform(context, lambda c: c["text"]), F.array(body)), "\n\n")
    return F.struct(kind.alias("chunk_type"), name.cast("string").alias("symbol_name"), line.cast("int").alias("symbol_start_line"), (line + newlines(body)).cast("int").alias("symbol_end_line"), ranges.alias("source_ranges"), content.alias("content"))


def bodies(content: Column, spans: Column, made: Callable[..., Column], trim: Callable[[Column], Column] = strip) -> Column:
    """``made(span, text, number)`` for each span. The text is turned to bytes once; a span costs its own length."""
    return let(F.encode(content, "UTF-8"), lambda raw: F.transform(spans, lambda p, i: let(trim(F.decode(F.substring(raw, p["a"] + 1, p["b"] - p["a"]), "UTF-8")), lambda body: made(p, body, i))))


def finished(files: DataFrame, pieces: Column, kind: Column) -> DataFrame:
    """A row for each piece; a file of text without one is a piece."""
    lines = F.size(F.split(F.regexp_replace("content", "\r?\n\\z", ""), "\n"))
    all_lines = F.struct(F.lit(1).alias("start_line"), lines.alias("end_line"))
    whole = F.struct(kind.alias("chunk_type"), F.lit(None).cast("string").alias("symbol_name"), F.lit(1).alias("symbol_start_line"), lines.alias("symbol_end_line"), F.array(all_lines).alias("source_ranges"), F.col("content").alias("content"))
    real = files.where(F.col("content").rlike(r"(?U)\S")).select(*KEY, "language", "content")
    made = real.select(*KEY, "language", F.explode(let(pieces, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(whole)))).alias("chunk"))
    return made.select(*KEY, "language", "chunk.*").select(*COLUMNS)


@once
def _json() -> Column:
    content = F.col("content")
    items = lexed(content, "json", {'"': '"', "//": "\n", "/*": "*/"}, ("//", "/*"), "{[", "}]", ",")
    plain = F.when(content.rlike(r"//|/\*"), F.regexp_replace(content, r"""(?s)("(?:[^"\\]|\\.)*+")|//[^\n]*+|/\*.*?\*/""", "$1")).otherwise(content)
    key = lambda body: F.regexp_extract(body, r"""(?s)^("(?:[^"\\]|\\.)*+")""", 1)
    decoded = lambda body: F.get(F.from_json(F.concat(F.lit("["), key(body), F.lit("]")), "array<string>"), F.lit(0))
    prop = lambda p, body, i: piece(F.lit("json_property"), decoded(body), p["line"], body)
    item = lambda p, body, i: piece(F.lit("json_array_item"), F.concat(F.lit("$["), i.cast("string"), F.lit("]")), p["line"], body)
    cut = lambda shut, made: bodies(content, separated(items, 1, False, shut)["out"], made)
    good = F.try_parse_json(plain).isNotNull()
    return F.when(content.rlike(r"(?U)^\s*\{") & good, cut("}", prop)).when(content.rlike(r"(?U)^\s*\[") & good, cut("]", item)).otherwise(none(PIECE))


def json(files: DataFrame) -> DataFrame:
    """A chunk for each property of the root object, its key decoded, or for each item of the root array. Comments are
    let pass as in configuration files; other roots, empty ones and texts that don't parse stay whole."""
    return finished(files, _json(), F.lit("json_document"))


PIECE = f"struct<chunk_type:string,symbol_name:string,symbol_start_line:int,symbol_end_line:int,source_ranges:array<{RANGE}>,content:string>"


@once
def _sql() -> Column:
    content = F.col("content")
    items = lexed(content, "sql", {"'": "'", '"': '"', "`": "`", "--": "\n", "/*": "*/"}, ("--", "/*"), separators=";")

    def made(p: Column, body: Column, i: Column) -> Column:
        kind = F.coalesce(*[F.when(body.rlike(pattern), F.lit(name)) for name, pattern in STATEMENTS], F.lit("sql_statement"))
        return piece(kind, F.when(~kind.isin("sql_select", "sql_statement"), F.nullif(F.regexp_extract(body, SQL_NAME, 1), F.lit(""))), p["line"], body)

    return bodies(content, separated(items, 0, False, "")["out"], made)


def sql(files: DataFrame) -> DataFrame:
    """A chunk for each statement, without its semicolon and the comments around it. Semicolons in strings, quoted names,
    comments and dollar-quoted bodies end none."""
    return finished(files, _sql(), F.lit("sql_document"))


@once
def _stylesheet() -> Column:
    content, quotes = F.col("content"), {'"': '"', "'": "'", "/*": "*/"}
    of = lambda kind, closers, comments: separated(lexed(content, kind, closers, comments, "{(", "})", ";"), 0, True, "}")["out"]
    spans = F.when(F.col("language") == "SCSS", of("scss", quotes | {"//": "\n"}, ("/*", "//"))).otherwise(of("css", quotes, ("/*",)))

    def made(p: Column, body: Column, i: Column) -> Column:
        at = F.lower(F.regexp_extract(body, r"^@([\w-]+)", 1))
        kinds = {"media": "css_media_query", "import": "css_import", "mixin": "scss_mixin", "function": "scss_function", "use": "scss_use", "forward": "scss_forward"}
        kind = F.lit("css_at_rule")
        for word, name in kinds.items():
            kind = F.when(at == word, F.lit(name)).otherwise(kind)
        kind = F.when(at.rlike("^(-[a-z]+-)?keyframes$"), F.lit("css_keyframes")).otherwise(kind)
        head = F.regexp_replace(F.regexp_extract(body, r"(?s)^((?:#\{[^{}]*\}|[^{])*+)", 1), r"[\s;]+$", "")
        other = F.when(body.rlike(r"^\$[\w-]+\s*:"), F.lit("scss_variable")).when(body.contains("{"), F.lit("css_rule")).otherwise(F.lit("css_declaration"))
        name = (
            F.when(kind.isin("scss_mixin", "scss_function", "css_keyframes") & (at != ""), F.regexp_extract(body, r"^@[\w-]+\s+([\w-]+)", 1))
            .when((at == "") & other.isin("scss_variable", "css_declaration"), F.regexp_extract(body, r"(?s)^([^:]*?)\s*:", 1)).otherwise(head)
        )
        return piece(F.when(at != "", kind).otherwise(other), F.nullif(name, F.lit("")), p["line"], body)

    return bodies(content, spans, made)


def stylesheet(files: DataFrame) -> DataFrame:
    """A chunk for each rule, at-rule and declaration at the top of a CSS or SCSS file; ``//`` comments in SCSS alone."""
    return finished(files, _stylesheet(), F.lit("stylesheet_document"))


@once
def _toml() -> Column:
    content = F.col("content")
    closers = {'"""': '"""', "'''": "'''", '"': '"', "'": "'", "#": "\n"}
    walked = separated(lexed(content, "toml", closers, ("#",), "{[", "}]", "\n"), 0, False, "", raw=True)
    kind = "struct<a:int,line:int,b:int,body:string>"

    def lines(raw: Column) -> Column:
        return F.transform(walked["out"], lambda p: F.struct(p["a"].alias("a"), p["line"].alias("line"), p["b"].alias("b"), strip(F.decode(F.substring(raw, p["a"] + 1, p["b"] - p["a"]), "UTF-8")).alias("body")))

    def tables(rows: Column) -> Column:
        """Spans of pairs before any table; a table's head takes in what follows up to the next."""
        zero = F.struct(F.lit(-1).alias("a"), F.lit(0).alias("line"), F.lit(0).alias("b"))
        head = lambda x: x["body"].startswith("[")
        step = lambda s, x: F.when(head(x), F.struct(x["a"].alias("a"), x["line"].alias("line"), x["b"].alias("b"))).when(s["a"] >= 0, F.struct(s["a"].alias("a"), s["line"].alias("line"), x["b"].alias("b"))).otherwise(s)
        given = lambda s, x, now: F.when(head(x), array_of(s, s["a"] >= 0, SPAN)).when(s["a"] < 0, F.array(F.struct(x["a"].alias("a"), x["line"].alias("line"), x["b"].alias("b")))).otherwise(none(SPAN))
        return let(scan(rows, zero, step, given, SPAN), lambda r: F.concat(r["out"], array_of(r["state"], r["state"]["a"] >= 0, SPAN)))

    def made(p: Column, body: Column, i: Column) -> Column:
        table, many = body.startswith("["), body.startswith("[[")
        name = F.when(table, F.regexp_extract(body, r"^\[+\s*([^\]]*?)\s*\]", 1)).otherwise(F.regexp_extract(body, r"""^((?:[^="']|"[^"]*"|'[^']*')*?)\s*=""", 1))
        return piece(F.when(many, F.lit("toml_table_array")).when(table, F.lit("toml_table")).otherwise(F.lit("toml_property")), name, p["line"], body)

    wrong = lambda x: ~x["body"].startswith("[") & ~x["body"].rlike(r"""^(?:[^="']|"[^"]*"|'[^']*')+?=\s*\S""")
    spans = let(let(F.encode(content, "UTF-8"), lines), lambda rows: F.when(walked["good"] & ~F.exists(rows, wrong), tables(rows)).otherwise(none(SPAN)))
    return bodies(content, spans, made)


def toml(files: DataFrame) -> DataFrame:
    """A chunk for each pair before the first table, and for each table with its pairs. A pair may span lines inside its
    strings and brackets."""
    return finished(files, _toml(), F.lit("toml_document"))


@once
def _yaml() -> Column:
    content = F.col("content")
    rows = F.transform(F.regexp_extract_all(content, F.lit(r"[^\n]*+\n|[^\n]++$"), F.lit(0)), lambda x: F.struct(x.alias("lex"), F.octet_length(x).alias("n")))
    kind = "struct<a:int,line:int,b:int,doc:int,name:string,item:int>"
    key = r"""^((?:"(?:[^"\\]|\\.)*+"|'[^']*+'|[^\s#\-\[\]{}"'&*!|>%@`,?:]|[\-?:](?=\S))(?:[^:#\n]|:(?=\S)|(?<=\S)#)*?)\s*:(?=\s|$)"""
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("line"), F.lit(1).alias("doc"), F.lit(False).alias("used"), F.lit(-1).alias("item"), F.lit(None).cast("string").alias("name"), F.lit(-1).alias("a"), F.lit(0).alias("begun"), F.lit(0).alias("b"), F.lit(False).alias("cut"), F.lit(True).alias("good"))

    def step(s: Column, x: Column) -> Column:
        line = F.regexp_replace(x["lex"], r"\r?\n$", "")
        mark, item, named = line.rlike(r"^(---|\.\.\.)(\s|$)"), line.rlike(r"^-(\s|$)"), F.regexp_extract(line, key, 1)
        begins = ~mark & (item | (named != ""))
        blank = line.rlike(r"^\s*(#.*)?$") | line.startswith("%")
        inside = ~mark & ~begins & ~blank
        a = F.when(s["cut"], -1).otherwise(s["a"])
        next_doc = mark & line.startswith("---") & s["used"]
        return F.struct(
            (s["at"] + x["n"]).alias("at"), (s["line"] + 1).alias("line"), (s["doc"] + next_doc.cast("int")).alias("doc"), F.when(mark, F.lit(False)).otherwise(s["used"] | ~blank).alias("used"),
            F.when(mark, -1).when(item, s["item"] + 1).otherwise(s["item"]).alias("item"), F.when(begins, F.when(item, F.lit(None).cast("string")).otherwise(F.regexp_replace(named, r"""^(["'])(.*)\1$""", "$2"))).otherwise(s["name"]).alias("name"),
            F.when(mark, -1).when(begins, s["at"]).otherwise(s["a"]).alias("a"), F.when(begins, s["line"] + 1).otherwise(s["begun"]).alias("begun"),
            F.when(begins | inside, s["at"] + F.octet_length(line)).otherwise(s["b"]).alias("b"), F.lit(False).alias("cut"), (s["good"] & ~(inside & (a < 0)) & ~(inside & line.rlike(r"^[^\s\]})]"))).alias("good"),
        )

    span = lambda s: F.struct(s["a"].alias("a"), s["begun"].alias("line"), s["b"].alias("b"), s["doc"].alias("doc"), s["name"].alias("name"), s["item"].alias("item"))
    walked = scan(rows, zero, step, lambda s, x, now: array_of(span(s), (s["a"] >= 0) & (now["a"] != s["a"]), kind), kind)
    spans = let(walked, lambda r: F.when(r["state"]["good"], F.concat(r["out"], array_of(span(r["state"]), r["state"]["a"] >= 0, kind))).otherwise(none(kind)))

    def made(p: Column, body: Column, i: Column, many: Column) -> Column:
        prefix = F.when(many, F.concat(F.lit("doc["), p["doc"].cast("string"), F.lit("]."))).otherwise(F.lit(""))
        name = F.concat(prefix, F.coalesce(p["name"], F.concat(F.lit("$["), p["item"].cast("string"), F.lit("]"))))
        return piece(F.when(p["name"].isNull(), F.lit("yaml_sequence_item")).otherwise(F.lit("yaml_property")), name, p["line"], body)

    open_flow = lambda text: F.regexp_extract(text, r"(?s)^[^\n:]*:?\s*([\[{].*)$", 1)
    count = lambda text, sign: F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))

    def balanced(chunks: Column) -> Column:
        odd = lambda c: let(open_flow(c["content"]), lambda v: (count(v, "[") != count(v, "]")) | (count(v, "{") != count(v, "}")))
        return F.when(F.exists(chunks, odd), none(PIECE)).otherwise(chunks)

    def cut(found: Column) -> Column:
        several = F.coalesce(F.array_max(F.transform(found, lambda p: p["doc"])), F.lit(1)) > 1
        return let(several, lambda many: bodies(content, found, lambda p, body, i: made(p, body, i, many)))

    return let(let(spans, cut), balanced)


def yaml(files: DataFrame) -> DataFrame:
    """A chunk for each key of a document's mapping, or each item of its list. A file with several documents names them
    ``doc[i].``. What is indented, and closing brackets, belong to the entry above; comments and blanks at its end don't."""
    return finished(files, _yaml(), F.lit("yaml_document"))


# elements


def tag_name(tag: Column) -> Column:
    return F.regexp_extract(tag, r"^</?\s*([^\s/>]+)", 1)


def descriptor(tag: Column) -> Column:
    """tag#id.class1.class2 of a start tag."""

    def of(name: str) -> Column:
        value = rf"""(?is)^<[^>]*?\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
        return F.concat(*[F.regexp_extract(tag, value, k) for k in (1, 2, 3)])

    id_, classes = of("id"), F.filter(F.split(of("class"), r"\s+"), lambda c: c != "")
    return F.concat(tag_name(tag), F.when(id_ != "", F.concat(F.lit("#"), id_)).otherwise(F.lit("")), F.array_join(F.transform(classes, lambda c: F.concat(F.lit("."), c)), ""))


TAG = "struct<line:int,text:string>"
ELEMENT = f"struct<a:int,line:int,b:int,tag:string,up:array<{TAG}>>"
OPEN = "struct<name:string,a:int,line:int,tag:string>"


def elements(content: Column, language: str, deepest: int) -> Column:
    """``(good, out)``: the elements up to a depth in order, each with its start tag and those of its ancestors.

    A stack of open elements goes along. In HTML an end tag ends what is still open inside its element, some start tags
    end what can't hold them, an end tag of nothing open is let pass, html, head and body may end with the text, and an
    ampersand may stand alone; in XML end tags must fit. Comments, scripts and styles are one lexeme each."""
    html = language == "html"
    kind = lambda x: (
        F.when(x.rlike(r"^<[!?]"), 0).when(x.rlike("^</"), 2).when(x.rlike(r"(?is)^<(script|style)\b.*</(script|style)\s*>$") if html else F.lit(False), 3)
        .when(F.lower(tag_name(x)).isin(*VOID) if html else F.lit(False), 3).when(x.rlike(r"(?s)^<[^<].*/>$"), 3).when(x.rlike("^<."), 1).when(x == "<", -1)
        .when(x.contains(">") if html else x.rlike("&(?!#?[A-Za-z0-9_:.-]+;)"), -1).otherwise(0)
    )
    fold = F.lower if html else lambda x: x

    def lexeme(x: Column) -> Column:
        name = fold(tag_name(x))
        ends = none("string")
        for names, gone in {tuple(k for k in ENDS if ENDS[k] == g): g for g in ENDS.values()}.items() if html else ():
            ends = F.when(name.isin(*names), F.array(*map(F.lit, gone))).otherwise(ends)
        return F.struct(F.octet_length(x).alias("n"), newlines(x).alias("nl"), kind(x).alias("kind"), name.alias("name"), ends.alias("ends"), F.when(x.startswith("<"), F.regexp_extract(x, r"""(?s)^(<(?:[^>"']|"[^"]*"|'[^']*')*+>)""", 1)).alias("tag"))

    zero = F.struct(F.lit(0).alias("at"), F.lit(1).alias("line"), F.lit(True).alias("good"), F.lit(0).alias("kept"), none(OPEN).alias("stack"))

    def step(s: Column, x: Column) -> Column:
        n = F.size(s["stack"])
        here = F.array_position(F.reverse(F.transform(s["stack"], lambda e: e["name"])), x["name"]).cast("int")
        holds = F.array_max(F.concat(F.array(F.lit(0)), F.transform(s["stack"], lambda e, i: F.when(F.array_contains(x["ends"], e["name"]), 0).otherwise(i + 1))))
        kept = F.when((x["kind"] == 2) & (here > 0), n - here).when(x["kind"].isin(1, 3) & (F.size(x["ends"]) > 0), holds).otherwise(n)
        own = F.struct(x["name"].alias("name"), s["at"].alias("a"), s["line"].alias("line"), x["tag"].alias("tag"))
        good = s["good"] & (x["kind"] != -1) & (F.lit(html) | (x["kind"] != 2) | (here == 1))
        stack = F.when(kept < n, F.slice(s["stack"], F.lit(1), kept)).otherwise(s["stack"])
        return F.struct((s["at"] + x["n"]).alias("at"), (s["line"] + x["nl"]).alias("line"), good.alias("good"), kept.alias("kept"), F.when(x["kind"] == 1, F.concat(stack, F.array(own))).otherwise(stack).alias("stack"))

    def element(e: Column, b: Column, stack: Column, depth: Column) -> Column:
        up = F.transform(F.slice(stack, F.lit(1), depth), lambda o: F.struct(o["line"].alias("line"), o["tag"].alias("text")))
        return F.struct(e["a"].alias("a"), e["line"].alias("line"), b.alias("b"), e["tag"].alias("tag"), up.alias("up"))

    def closed(stack: Column, kept: Column, end: Callable[[Column], Column]) -> Column:
        """What is open above ``kept``, up to the depth."""
        return F.transform(F.slice(stack, kept + 1, F.greatest(F.lit(0), F.least(F.size(stack), F.lit(deepest + 1)) - kept)), lambda e, i: element(e, end(kept + i), stack, kept + i))

    def emit(s: Column, x: Column, now: Column) -> Column:
        gone = F.when((now["kept"] < F.size(s["stack"])) & (now["kept"] <= deepest), closed(s["stack"], now["kept"], lambda depth: F.when((x["kind"] == 2) & (depth == now["kept"]), now["at"]).otherwise(s["at"]))).otherwise(none(ELEMENT))
        own = F.struct(s["at"].alias("a"), s["line"].alias("line"), x["tag"].alias("tag"))
        return F.concat(gone, array_of(element(own, now["at"], now["stack"], now["kept"]), (x["kind"] == 3) & (now["kept"] <= deepest), ELEMENT))

    def last(r: Column) -> Column:
        s = r["state"]
        may_end = F.forall(s["stack"], lambda e: e["name"].isin("html", "head", "body")) if html else F.size(s["stack"]) == 0
        rest = closed(s["stack"], F.lit(0), lambda depth: s["at"])
        return F.struct((s["good"] & may_end).alias("good"), F.array_sort(F.concat(r["out"], rest)).alias("out"))

    found = F.transform(F.regexp_extract_all(content, F.lit(LEXEMES[language]), F.lit(0)), lexeme)
    return let(scan(found, zero, step, emit, ELEMENT), last)


@once
def _html() -> Column:
    content = F.col("content")
    is_ = lambda tag, name: F.lower(tag_name(tag)) == name

    def chosen(out: Column) -> Column:
        up = lambda p, k: F.get(p["up"], F.lit(k))["text"]
        empty = lambda p: ~F.exists(out, lambda q: (F.size(q["up"]) == 2) & (q["a"] > p["a"]) & (q["a"] < p["b"]))
        return F.filter(out, lambda p: F.when(F.size(p["up"]) == 0, ~is_(p["tag"], "html")).when(F.size(p["up"]) == 1, is_(up(p, 0), "html") & (~is_(p["tag"], "body") | empty(p))).otherwise(is_(up(p, 0), "html") & is_(up(p, 1), "body")))

    spans = let(elements(content, "html", 2), lambda r: F.when(r["good"], chosen(r["out"])).otherwise(none(ELEMENT)))

    def made(p: Column, body: Column, i: Column) -> Column:
        name = F.array_join(F.concat(F.transform(p["up"], lambda t: descriptor(t["text"])), F.array(descriptor(p["tag"]))), " > ")
        return piece(F.lit("html_element"), name, p["line"], body, p["up"])

    return bodies(content, spans, made)


def html(files: DataFrame) -> DataFrame:
    """A chunk for each element at the root, below html and below its body, named by the descriptors on its path; the start
    tags of html and body stand before it. A body without elements is a chunk itself."""
    return finished(files, _html(), F.lit("html_document"))


@once
def _xml() -> Column:
    content = F.col("content")
    roots = lambda out: F.size(F.filter(out, lambda p: F.size(p["up"]) == 0))
    spans = let(elements(content, "xml", 1), lambda r: F.when(r["good"] & (roots(r["out"]) == 1), F.filter(r["out"], lambda p: F.size(p["up"]) == 1)).otherwise(none(ELEMENT)))

    def made(p: Column, body: Column, i: Column) -> Column:
        return piece(F.lit("xml_element"), F.concat(tag_name(F.get(p["up"], F.lit(0))["text"]), F.lit(" > "), tag_name(p["tag"])), p["line"], body, p["up"])

    return bodies(content, spans, made)


def xml(files: DataFrame) -> DataFrame:
    """A chunk for each child of the root, after the root's start tag."""
    return finished(files, _xml(), F.lit("xml_document"))
