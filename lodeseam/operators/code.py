"""Code to declarations, by one pass over a file inside its row.

Languages with braces: the pass goes over lexemes, strings and comments left out of account. What stands between two
boundaries (a brace, a semicolon outside of parentheses, and where the language ends statements so, a line end) is a head.
At an opening brace the head is told by patterns of its language; a declaration goes onto a stack and ends with its brace.
Heads may span lines, several declarations may stand on one, and nested ones are chunks of their own. Python and Ruby: the
pass goes over lines, and the stack holds declarations by rising indentation; a line that is indented as little ends them,
closing brackets and ``end`` excepted.

A class, or what else only holds others, is given as its head and those of its members that hold no declaration, each a
part of the content with lines of its own; functions, methods and constructors are given whole. A file's cost grows with
its lexemes; no declaration looks at the file again. This tells declarations by their heads and does not parse: what a macro
or a string builds is not seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseam.functions.scan import let, none, once, scan
from lodeseam.operators.structured import COLUMNS, KEY, RANGE, array_of, newlines, strip

_JS = ("JavaScript", "JavaScript JSX", "TypeScript", "TypeScript TSX")
_TS = _JS[2:]
_C = ("C", "C Header", "C++", "C++ Header")
_KOTLIN = ("Kotlin", "Kotlin Script")
_CONTROL = r"(?:if|for|foreach|while|switch|catch|else|do|try|return|new|throw|case|when|using|lock|synchronized|guard|match|loop|defer|select|finally|sizeof|elif|until|unless)"
_CALL = r"\b(?!" + _CONTROL + r"\b)(~?\w+)\s*\((?:[^(){}]|\((?:[^(){}]|\([^(){}]*\))*\))*\)"

#: Heads of declarations with a body, the first that fits counts: languages, kind, pattern with the name in its first group.
HEADS = (
    (("Java", "C#", "Kotlin", "Kotlin Script"), "record_context", r"\brecord\s+(?:class\s+|struct\s+)?(\w+)"),
    ((*_KOTLIN, "C++", "C++ Header", "Java", "C#", "Swift", "PHP", *_TS, "C", "C Header", "Rust"), "enum_context", r"\benum\s+(?:class\s+|struct\s+)?(\w+)"),
    (("Java", "C#", "PHP", *_KOTLIN, *_TS), "interface_context", r"\binterface\s+(\w+)"),
    (("PHP", "Rust"), "trait_context", r"\btrait\s+(\w+)"),
    (("Swift",), "protocol_context", r"\bprotocol\s+(\w+)"),
    (("Swift",), "extension_context", r"\bextension\s+(\w+)"),
    (("Rust",), "impl_context", r"\bimpl\b(?:\s*<[^>]*>)?\s+(?:[\w:<>,&' ]+\s+for\s+)?(\w+)"),
    (("Rust",), "module_context", r"\bmod\s+(\w+)"),
    (("Rust", "C#", "Swift", *_C), "struct_context", r"\bstruct\s+(\w+)(?![^{]*\))"),
    (("C", "C Header", "C++", "C++ Header"), "union_context", r"\bunion\s+(\w+)(?![^{]*\))"),
    (("Go",), "struct_context", r"\btype\s+(\w+)(?:\[[^\]]*\])?\s+struct\b"),
    (("Go",), "interface_context", r"\btype\s+(\w+)(?:\[[^\]]*\])?\s+interface\b"),
    (("C++", "C++ Header", "C#", "PHP"), "namespace_context", r"\bnamespace\s+([\w.:\\]+)"),
    (("Java", "C#", "PHP", "Swift", *_KOTLIN, *_JS, "C++", "C++ Header"), "class_context", r"(?<![.\w])class\s+(\w+)"),
    (("Go",), "method", r"\bfunc\s+\([^)]*\)\s*(\w+)"),
    (("Go", "Swift"), "function", r"\bfunc\s+(\w+)"),
    (("Swift",), "constructor", r"(?<![.\w])(init)\s*[?!]?\s*(?:<[^>]*>)?\s*\("),
    (("Rust",), "function", r"\bfn\s+(\w+)"),
    (_KOTLIN, "function", r"\bfun\s+(?:<[^>]*>\s*)?(?:[\w<>?]+\.)?(\w+)\s*\("),
    (("PHP",), "function", r"\bfunction\s+&?(\w+)"),
    (("Shell",), "function", r"(?:^|\s)function\s+([\w-]+)\s*(?:\(\s*\))?\s*$"),
    (("Shell",), "function", r"(?:^|\s)([\w-]+)\s*\(\s*\)\s*$"),
    (_JS, "function", r"\bfunction\s*\*?\s*(\w+)\s*(?:<[^>]*>)?\s*\("),
    (_JS, "function", r"(?s)^\s*(?:export\s+)?(?:default\s+)?(?:const|let|var)\s+(\w+)\s*(?::.*?)?=\s*(?:async\s*)?(?:function\b.*|(?:\(.*\)|\w+)\s*(?::.*)?=>\s*)$"),
    (_JS, "member", r"(?s)^\s*(?:(?:public|private|protected|static|async|get|set|readonly|override|abstract|declare)\s+|\*\s*)*(?!" + _CONTROL + r"\b|function\b)(#?\w+)\s*(?:<[^>]*>)?\s*\(.*\)\s*(?::[^=]*)?$"),
    (("Java", "C#"), "member", r"(?s)^(?!.*(?:[=.]|->|\bnew\b)[^()]*" + _CALL.replace(r"(~?\w+)", r"~?\w+") + r"\s*$)(?:.*?)" + _CALL + r"\s*(?:throws\b[\w\s,.]+|where\b.*|:\s*(?:base|this)\s*\(.*\))?\s*$"),
    (_C, "callable", r"(?s)^(?!.*=[^=()]*$)(?:.*?)([\w~]+(?:::~?\w+)*)\s*\((?:[^(){}]|\((?:[^(){}]|\([^(){}]*\))*\))*\)\s*(?:const|noexcept|override|final|\s|->\s*[\w:<>*& ]+|:\s*\w+\s*[({].*)*$"),
)
#: Declarations without a body, told at a semicolon: a signature in what holds others, or a record, namespace or alias.
BARE = (
    (("Java", "C#"), "record_context", r"\brecord\s+(\w+)\s*\("),
    (("C#", "PHP"), "namespace_context", r"\bnamespace\s+([\w.\\]+)\s*$"),
    (_TS, "type_alias", r"(?s)^\s*(?:export\s+)?type\s+(\w+)\s*(?:<[^>]*>)?\s*="),
    (_JS, "declaration", r"(?s)^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]*)?=\s*(?:new\b|[\[{]|\w[\w.]*\s*\()"),
    (_JS, "function", r"(?s)^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::.*?)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]*)?=>"),
    (("Java", "C#"), "signature", r"(?s)^(?!.*[=.]\s*\w+\s*\()\s*[\w@<>\[\],.?\s]*[\w>\]]\s+(\w+)\s*\([^()]*\)\s*(?:throws\b.*)?$"),
    (("PHP",), "signature", r"\bfunction\s+&?(\w+)"),
)
CONSTRUCTORS = ("constructor", "__construct", "initialize", "__init__", "init")
HOLDERS = ("class_context", "interface_context", "trait_context", "struct_context", "enum_context", "record_context", "protocol_context", "extension_context", "impl_context", "union_context")
#: Languages whose statements end with the line.
BY_LINE = ("Go", "Swift", "Shell", *_KOTLIN, *_JS)
BY_INDENT = ("Python", "Ruby")
#: Strings and comments as one lexeme each, for languages whose apostrophe begins no string and whose strings end with the
#: line; a string that doesn't end goes up to the line's end.
_QUOTED = r"""\"{3}(?:[^"\\]++|\\.|"(?!""))*+\"{3}|"(?!"")(?:[^"\\\n]++|\\.)*+["\n]|`(?:[^`\\]++|\\.)*+`|//(?:[^\n\\]++|\\.?+)*+|/\*.*?\*/|"""
_HASHED = r"#(?:[^\n\\]++|\\.?+)*+|"
_SIGNS = r"""\\.|\"{3}|'(?:[^'\\\n]|\\[^\n][^'\n]{0,9})'|["'`{}();\n]|//|/\*|\*/|#|(?:[^\\"'`{}();\n/*#]|/(?![/*])|\*(?!/))++|."""

LEXEMES = "(?s)" + _SIGNS
WHOLE = "(?s)" + _QUOTED + _SIGNS
WHOLE_C = "(?s)" + _HASHED + WHOLE.removeprefix("(?s)")

FOUND = f"struct<a:int,b:int,line:int,kind:string,name:string,parent:int,brace:int,brace_line:int>"
FRAME = "struct<a:int,line:int,kind:string,name:string,parens:int,brace:int,brace_line:int,head:int,head_line:int>"


def _told(head: Column, table: tuple) -> Column:
    """``(kind, name)`` of a head by the first pattern that fits; null where none does."""
    out = F.lit(None).cast("struct<kind:string,name:string>")
    for languages, kind, pattern in reversed(table):
        out = F.when(F.col("language").isin(*languages) & head.rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(head, pattern, 1).alias("name"))).otherwise(out)
    return out


def _named(told: Column, holder: Column) -> Column:
    """The kind in its place: members are methods or constructors of what holds them."""
    inside, name = F.coalesce(holder["kind"].isin(*HOLDERS), F.lit(False)), told["name"]
    constructs = name.isin(*CONSTRUCTORS) | (name == holder["name"]) & ~F.col("language").isin("Go", "Rust", *_JS, *_KOTLIN)
    method = F.when(F.coalesce(inside & constructs, F.lit(False)), "constructor").otherwise("method")
    kind = (
        F.when(told["kind"].isin("member", "signature"), F.when(inside, method)).when(told["kind"] == "callable", F.when(inside | name.contains("::"), method).otherwise("function"))
        .when((told["kind"] == "function") & inside & F.coalesce(holder["kind"] != "enum_context", F.lit(True)), method).otherwise(told["kind"])
    )
    # a trait of PHP or Rust holds functions as a class does
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.try_element_at(F.split(name, "::"), F.lit(-1)).alias("name")))


@once
def _braces() -> Column:
    content, language = F.col("content"), F.col("language")
    hashes = language.isin("PHP", "Shell", *_C)
    quoted = language.isin("PHP", "Shell", *_JS)

    def lexeme(x: Column, whole: bool = False) -> Column:
        closer = F.when(x.isin('"', "`", '"""'), x).when((x == "'") & quoted, x).when((x == "//") & (language != "Shell"), F.lit("\n")).when(x == "/*", F.lit("*/")).when((x == "#") & hashes, F.lit("\n")).otherwise(F.lit(""))
        comment = (closer != "") & x.isin("//", "/*", "#") | (closer == "") & (x.rlike("^(?://.|/[*].|#.)") if whole else F.lit(False))
        return F.struct(x.alias("lex"), F.octet_length(x).alias("n"), newlines(x).alias("nl"), (~x.rlike(r"(?U)\S")).alias("blank"), closer.alias("closer"), comment.alias("comment"))

    def walked(raw: Column) -> Column:
        nothing = F.lit(None).cast(FOUND)
        zero = F.struct(
            F.lit(0).alias("at"), F.lit(1).alias("line"), F.lit("").alias("open"), F.lit(False).alias("comment"), F.lit(0).alias("parens"), F.lit(-1).alias("head"), F.lit(0).alias("head_line"),
            F.lit(0).alias("last"), F.lit(False).alias("fresh"), none(FRAME).alias("stack"), nothing.alias("gone"), nothing.alias("bare"),
        )
        text = lambda a, b: strip(F.decode(F.substring(raw, a + 1, b - a), "UTF-8"))

        def step(s: Column, x: Column) -> Column:
            quiet = s["open"] == ""
            comment = F.when(quiet, x["comment"]).otherwise(s["comment"])
            closes = (s["open"] == x["lex"]) | (s["open"].isin('"', "'") & (x["lex"] == "\n") & ~language.isin("PHP", "Shell", "Rust"))
            live = quiet & (x["closer"] == "")
            opens, shuts = live & (x["lex"] == "{"), live & (x["lex"] == "}")
            ends = live & (x["lex"] == ";") & (s["parens"] == 0)
            solid = ~comment & (~quiet | ~x["blank"])
            restart = s["fresh"] & solid & ~opens & ~shuts & ~x["lex"].startswith(")")
            head = F.when(restart | (s["head"] < 0) & solid, s["at"]).otherwise(s["head"])
            head_line = F.when(restart | (s["head"] < 0) & solid, s["line"]).otherwise(s["head_line"])
            holder = F.try_element_at(s["stack"], F.lit(-1))
            depth = F.size(s["stack"])
            top = F.when(depth > 0, holder)
            asked = opens | (ends & (s["head"] >= 0)) | (shuts & (s["head"] >= 0)) | (restart & (s["head"] >= 0))
            body = F.when(asked, text(s["head"], s["last"]))
            found = lambda text: F.when(opens & (s["head"] >= 0) & (s["parens"] == 0), _told(text, HEADS)).when(~opens & asked, _told(text, BARE))
            def moved(told: Column) -> Column:
                frame = F.struct(
                    F.when(s["head"] >= 0, s["head"]).otherwise(s["at"]).alias("a"), F.when(s["head"] >= 0, s["head_line"]).otherwise(s["line"]).alias("line"), told["kind"].alias("kind"), told["name"].alias("name"),
                    s["parens"].alias("parens"), s["at"].alias("brace"), s["line"].alias("brace_line"), s["head"].alias("head"), s["head_line"].alias("head_line"),
                )
                stack = F.when(opens, F.concat(s["stack"], F.array(frame))).when(shuts & (depth > 0), F.slice(s["stack"], F.lit(1), F.greatest(F.lit(0), depth - 1))).otherwise(s["stack"])
                # a closed declaration ends its statement; another brace leaves the head open, as what follows may belong to it
                bare = F.when(depth > 0, holder["kind"].isNull() & (holder["head"] >= 0) & (holder["parens"] > 0))
                back = shuts & F.coalesce(bare, F.lit(False))
                parent = F.when(depth > 0, F.coalesce(F.try_element_at(F.filter(s["stack"], lambda f: f["kind"].isNotNull()), F.lit(-1))["a"], F.lit(-1))).otherwise(-1)
                outer = F.coalesce(F.try_element_at(F.filter(F.slice(s["stack"], F.lit(1), F.greatest(F.lit(0), depth - 1)), lambda f: f["kind"].isNotNull()), F.lit(-1))["a"], F.lit(-1))
                member = F.when(depth > 0, F.coalesce(holder["kind"].endswith("_context"), F.lit(False))).otherwise(F.lit(False))
                by_bare = F.struct(s["head"].alias("a"), s["last"].alias("b"), s["head_line"].alias("line"), F.coalesce(told["kind"], F.lit("part")).alias("kind"), told["name"].alias("name"), parent.alias("parent"), F.lit(-1).alias("brace"), F.lit(0).alias("brace_line"))
                by_brace = F.struct(holder["a"].alias("a"), (s["at"] + 1).alias("b"), holder["line"].alias("line"), holder["kind"].alias("kind"), holder["name"].alias("name"), outer.alias("parent"), holder["brace"].alias("brace"), holder["brace_line"].alias("brace_line"))
                gone = F.when((ends | shuts | restart) & (s["head"] >= 0) & (told["kind"].isNotNull() | member) & ~(shuts & (depth == 0)), by_bare)
                closed = F.when(shuts & (depth > 0), F.when(holder["kind"].isNotNull(), by_brace))
                after = F.when(back, holder["head"]).when(opens | shuts | ends, -1).otherwise(head)
                return F.struct(
                    (s["at"] + x["n"]).alias("at"), (s["line"] + x["nl"]).alias("line"), F.when(quiet, x["closer"]).when(closes, F.lit("")).otherwise(s["open"]).alias("open"), comment.alias("comment"),
                    F.when(opens, 0).when(shuts & (depth > 0), holder["parens"]).when(live & (x["lex"] == "("), s["parens"] + 1).when(live & (x["lex"] == ")"), F.greatest(F.lit(0), s["parens"] - 1)).otherwise(s["parens"]).alias("parens"),
                    after.alias("head"), F.when(back, holder["head_line"]).otherwise(head_line).alias("head_line"), F.when(solid, s["at"] + x["n"]).otherwise(s["last"]).alias("last"),
                    (language.isin(*BY_LINE) & F.when((quiet | (s["open"] == "\n")) & (x["lex"] == "\n"), s["parens"] == 0).when(solid, F.lit(False)).otherwise(s["fresh"])).alias("fresh"),
                    stack.alias("stack"), F.coalesce(closed, F.lit(None).cast(FOUND)).alias("gone"), gone.alias("bare"),
                )

            return let(body, lambda text: let(found(text), lambda t: let(top, lambda h: let(_named(t, h), lambda told: moved(told)))))

        cut = lambda pattern, whole: F.transform(F.regexp_extract_all(content, F.lit(pattern), F.lit(0)), lambda x: lexeme(x, whole))
        lexed = F.when(quoted | (language == "Rust"), cut(LEXEMES, False)).when(hashes, cut(WHOLE_C, True)).otherwise(cut(WHOLE, True))
        items = F.concat(lexed, F.array(lexeme(F.lit("\n")), F.struct(F.lit(";").alias("lex"), F.lit(0).alias("n"), F.lit(0).alias("nl"), F.lit(False).alias("blank"), F.lit("").alias("closer"), F.lit(False).alias("comment"))))
        given = lambda s, x, now: F.concat(array_of(now["bare"], now["bare"].isNotNull(), FOUND), array_of(now["gone"], now["gone"].isNotNull(), FOUND))
        return scan(items, zero, step, given, FOUND)["out"]

    return let(F.encode(content, "UTF-8"), walked)


@once
def _indents() -> Column:
    content, language = F.col("content"), F.col("language")
    rows = F.transform(F.regexp_extract_all(content, F.lit(r"[^\n]*+\n|[^\n]++$"), F.lit(0)), lambda x: let(F.regexp_replace(x, r"[\r\n]+$", ""), lambda bare: F.struct(bare.alias("text"), F.octet_length(x).alias("n"), F.octet_length(bare).alias("inner"), F.length(F.regexp_extract(F.regexp_replace(bare, "\t", "    "), "^( *)", 1)).alias("indent"))))
    frame = "struct<a:int,line:int,kind:string,name:string,indent:int,body:int,body_line:int>"
    zero = F.struct(F.lit(0).alias("at"), F.lit(1).alias("line"), F.lit("").alias("open"), F.lit(0).alias("end"), none(frame).alias("stack"), F.lit(0).alias("kept"), F.lit(-1).alias("part"), F.lit(0).alias("part_line"), F.lit(0).alias("part_indent"), none(FOUND).alias("gone"))
    python = r"^\s*(?:class|(?:async\s+)?def)\s+(\w+)"
    ruby = r"^\s*(?:class|module|def)\s+(?:self\.)?([\w:?!=]+)"

    def step(s: Column, x: Column) -> Column:
        line = x["text"]
        triples = F.regexp_extract_all(line, F.lit("\"\"\"|'''"), F.lit(0))
        inside = s["open"] != ""
        opened = F.aggregate(triples, s["open"], lambda o, m: F.when(o == "", m).when(o == m, F.lit("")).otherwise(o))
        text = line.rlike(r"\S") & (inside | ~line.rlike(r"^\s*#"))
        continues = inside | line.rlike(r"^\s*[\])}]") | (language == "Ruby") & line.rlike(r"^\s*(end|else|elsif|rescue|ensure|when)\b") | ~text
        name = F.when(~inside & text, F.when(language == "Python", F.regexp_extract(line, python, 1)).otherwise(F.regexp_extract(line, ruby, 1))).otherwise("")
        holds = line.rlike(r"^\s*(class|module)\b")
        keep = F.when(inside | ~text, F.size(s["stack"])).otherwise(F.size(F.filter(s["stack"], lambda f: (f["indent"] < x["indent"]) | continues & (f["indent"] == x["indent"]))))
        stack = F.slice(s["stack"], F.lit(1), keep)
        holder = F.when(keep > 0, F.try_element_at(stack, F.lit(-1)))
        in_class = F.coalesce(holder["kind"] == "class_context", F.lit(False))
        kind = F.when(holds, F.when(line.rlike(r"^\s*module"), "module_context").otherwise("class_context")).when(in_class, F.when(name.isin(*CONSTRUCTORS), "constructor").otherwise("method")).otherwise(F.when(language == "Ruby", "method").otherwise("function"))
        begins = name != ""
        own = F.struct((s["at"] + F.octet_length(F.regexp_extract(line, r"^(\s*)", 1))).alias("a"), s["line"].alias("line"), kind.alias("kind"), name.alias("name"), x["indent"].alias("indent"), (s["at"] + x["inner"]).alias("body"), s["line"].alias("body_line"))
        place = lambda i: F.when(i > 0, F.try_element_at(s["stack"], i)["a"]).otherwise(-1)
        done = F.transform(F.slice(s["stack"], keep + 1, F.greatest(F.lit(0), F.size(s["stack"]) - keep)), lambda f, i: F.struct(f["a"].alias("a"), s["end"].alias("b"), f["line"].alias("line"), f["kind"].alias("kind"), f["name"].alias("name"), place(keep + i).alias("parent"), f["body"].alias("brace"), f["body_line"].alias("brace_line")))
        # a member of a class begins on a line that is indented as the class's first, and goes on below it
        top = F.when(F.size(s["stack"]) > 0, F.try_element_at(s["stack"], F.lit(-1)))
        breaks = text & ~inside & ((x["indent"] <= s["part_indent"]) & ~continues | begins | (keep < F.size(s["stack"])))
        part = F.struct(s["part"].alias("a"), s["end"].alias("b"), s["part_line"].alias("line"), F.lit("part").alias("kind"), F.lit(None).cast("string").alias("name"), top["a"].alias("parent"), F.lit(-1).alias("brace"), F.lit(0).alias("brace_line"))
        ended = array_of(part, (s["part"] >= 0) & breaks & F.coalesce(top["kind"].endswith("_context"), F.lit(False)), FOUND)
        starts = text & ~inside & ~begins & ~continues & ~line.rlike(r"^\s*@") & F.coalesce(holder["kind"].endswith("_context"), F.lit(False)) & ((s["part"] < 0) | breaks)
        return F.struct(
            (s["at"] + x["n"]).alias("at"), (s["line"] + 1).alias("line"), F.when(language == "Python", opened).otherwise("").alias("open"), F.when(text, s["at"] + x["inner"]).otherwise(s["end"]).alias("end"),
            F.when(begins, F.concat(stack, F.array(own))).otherwise(stack).alias("stack"), keep.alias("kept"),
            F.when(starts, s["at"] + F.octet_length(F.regexp_extract(line, r"^(\s*)", 1))).when(breaks, -1).otherwise(s["part"]).alias("part"), F.when(starts, s["line"]).otherwise(s["part_line"]).alias("part_line"), F.when(starts, x["indent"]).otherwise(s["part_indent"]).alias("part_indent"),
            F.concat(ended, done).alias("gone"),
        )

    last = F.struct(F.lit("x").alias("text"), F.lit(0).alias("n"), F.lit(0).alias("inner"), F.lit(-1).alias("indent"))
    return scan(F.concat(rows, F.array(last)), zero, step, lambda s, x, now: now["gone"], FOUND)["out"]


def declarations(files: DataFrame) -> DataFrame:
    """A chunk for each declaration in the order of the file, and none for a file without."""
    found = F.when(F.col("language").isin(*BY_INDENT), _indents()).otherwise(_braces())
    content = F.col("content")

    def chunks(raw: Column, out: Column) -> Column:
        text = lambda a, b: strip(F.decode(F.substring(raw, a + 1, b - a), "UTF-8"))
        span = lambda line, body: F.struct(line.alias("start_line"), (line + newlines(body)).alias("end_line"))
        holds = lambda p: p["kind"].endswith("_context") & (p["brace"] >= 0)

        def context(p: Column) -> Column:
            """Head and members; a part that holds a declaration is none."""
            own = F.filter(out, lambda q: (q["kind"] == "part") & (q["parent"] == p["a"]) & (q["a"] > p["a"]))
            parts = F.transform(own, lambda q: let(text(q["a"], q["b"]), lambda body: F.struct(body.alias("body"), span(q["line"], body).alias("span"))))
            head = let(text(p["a"], p["brace"]), lambda body: F.struct(body.alias("body"), F.struct(p["line"].alias("start_line"), F.greatest(p["line"], p["brace_line"] - 1).alias("end_line")).alias("span")))
            return let(F.concat(F.array(head), parts), lambda all_: F.struct(F.array_join(F.transform(all_, lambda x: x["body"]), "\n\n").alias("content"), F.array_distinct(F.transform(all_, lambda x: x["span"])).alias("source_ranges")))

        def made(p: Column) -> Column:
            whole = text(p["a"], p["b"])
            both = F.when(holds(p), context(p)).otherwise(let(whole, lambda body: F.struct(body.alias("content"), F.array(span(p["line"], body)).alias("source_ranges"))))
            return let(both, lambda c: F.struct(p["kind"].alias("chunk_type"), p["name"].alias("symbol_name"), p["line"].alias("symbol_start_line"), (p["line"] + newlines(whole)).alias("symbol_end_line"), c["source_ranges"].alias("source_ranges"), c["content"].alias("content")))

        return F.transform(F.filter(out, lambda p: p["kind"] != "part"), made)

    pieces = let(F.encode(content, "UTF-8"), lambda raw: let(F.array_sort(found), lambda out: chunks(raw, out)))
    rows = files.where(content.rlike(r"(?U)\S")).select(*KEY, "language", F.explode(pieces).alias("chunk"))
    return rows.select(*KEY, "language", "chunk.*").select(*COLUMNS)
