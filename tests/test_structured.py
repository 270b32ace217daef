"""Chunks of structured files against small cases and plain versions."""

import json
import random

import pytest

from lodeseam.functions.scan import none, scan
from lodeseam.operators import structured as S
from tests.test_chunks import files, found
from pyspark.sql import functions as F


def test_scan_is_a_prefix_sum(spark):
    rows = [[], [3], list(range(100)), [1] * 3000]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, xs array<int>")
    ran = scan(F.col("xs"), F.struct(F.lit(0).alias("sum")), lambda s, x: F.struct((s["sum"] + x).alias("sum")), lambda s, x, now: F.array(now["sum"]), "int")
    for r in df.select("id", ran.alias("r")).collect():
        assert r.r.out == [sum(rows[r.id][: k + 1]) for k in range(len(rows[r.id]))] and r.r.state.sum == sum(rows[r.id])
    assert df.select(none("int").alias("x")).first().x == []


def test_json(spark):
    text = '{\n  "name": "demo",\n  "scripts": {\n    "build": "x, }"\n  },\n  "dis\\u0070lay \\"n\\"": 1\n}'
    assert found(S.json(files(spark, "JSON", text))) == [("json_property", "name", [(2, 2)]), ("json_property", "scripts", [(3, 5)]), ("json_property", 'display "n"', [(6, 6)])]
    assert [x[:2] for x in found(S.json(files(spark, "JSON", '[{"a": [1, 2]}, "x,y"]')))] == [("json_array_item", "$[0]"), ("json_array_item", "$[1]")]
    for whole in ("{}", "[]", '{"a": ', "1", "[1,]", '"x"'):
        assert found(S.json(files(spark, "JSON", whole))) == [("json_document", None, [(1, 1)])]
    assert found(S.json(files(spark, "JSON", " \n", None))) == []
    assert [x[1] for x in found(S.json(files(spark, "TypeScript Configuration", '{ // a, "x": 1\n "b": "//", /* , */ "c": 2 }')))] == ["b", "c"]


def test_json_against_the_parser(spark):
    """Properties of random objects: keys, values and lines are those of the text."""
    rng = random.Random(3)

    def value(depth):
        kind = rng.randrange(6 if depth else 4)
        return [lambda: rng.randint(-9, 9), lambda: rng.choice(['a"b', "c\\", "{,}", "[", "\n\t", "é😀", ""]), lambda: None, lambda: rng.random(), lambda: [value(depth - 1) for _ in range(rng.randrange(4))], lambda: {f"k{i}": value(depth - 1) for i in range(rng.randrange(4))}][kind]()

    made = [{f'key"{i}': value(3) for i in range(rng.randrange(1, 6))} for _ in range(40)]
    texts = [json.dumps(m, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5) for m in made]
    rows = S.json(files(spark, "JSON", *texts)).collect()
    for i, (m, text) in enumerate(zip(made, texts)):
        own = sorted((r for r in rows if r.file_path == f"f{i}"), key=lambda r: text.index(r.content))
        assert {k: v for r in own for k, v in json.loads("{" + r.content + "}").items()} == m and [r.symbol_name for r in own] == list(m)
        assert all(r.symbol_start_line == 1 + text[: text.index(r.content)].count("\n") and r.symbol_end_line == r.symbol_start_line + r.content.count("\n") for r in own)


def test_many_items(spark):
    n = 20_000
    assert S.json(files(spark, "JSON", "[" + ",".join(map(str, range(n))) + "]")).where("symbol_name = concat('$[', content, ']')").count() == n


def test_sql(spark):
    text = "create table users (id int);\ncreate view active_users as\n select * from users;\ninsert into users values (1);\nselect 1;\ncreate function user_count() returns int as $$\n select 1;\n$$ language sql;"
    assert [x[:2] for x in found(S.sql(files(spark, "SQL", text)))] == [("sql_create_table", "users"), ("sql_create_view", "active_users"), ("sql_insert", "users"), ("sql_select", None), ("sql_create_function", "user_count")]
    text = "-- a; b\nINSERT INTO t VALUES ('x;''y'); UPDATE \"a;b\" SET c = 1 /* ; */;;\n DROP TABLE IF EXISTS `q` -- ;\n"
    assert found(S.sql(files(spark, "SQL", text))) == [("sql_insert", "t", [(2, 2)]), ("sql_update", '"a;b"', [(2, 2)]), ("sql_drop_table", "`q`", [(3, 3)])]
    assert found(S.sql(files(spark, "SQL", "-- only\n/* ; */"))) == [("sql_document", None, [(1, 2)])]


def plain_statements(text):
    """By character."""
    out, at, open_, now = [], 0, "", ""
    while at < len(text):
        if not open_:
            for sign, end in (("--", "\n"), ("/*", "*/"), ("$$", "$$"), ("'", "'")):
                if text.startswith(sign, at):
                    open_, step = end, len(sign)
                    break
            else:
                step = 1
                if text[at] == ";":
                    out.append(now)
                    now, at = "", at + 1
                    continue
            if open_ not in ("\n", "*/"):
                now += text[at : at + step]
            elif not now.strip():
                now = ""
            else:
                now += text[at : at + step]
            at += step
        else:
            step = len(open_) if text.startswith(open_, at) else 1
            if open_ not in ("\n", "*/") or now.strip():
                now += text[at : at + step]
            if text.startswith(open_, at):
                open_ = ""
            at += step
    import re

    trailing = re.compile(r"(?s)(\s+|--[^\n]*(\n|$)|/\*((?!\*/).)*(\*/|$))+$")
    return [s for s in (x.strip() for x in (*out, now)) if s], trailing


def test_sql_against_a_walk_by_character(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["select 1", ";", "'", "'a;b'", "$$", " ", "\n", "x"]) for _ in range(rng.randrange(1, 30))) + "\nselect" for _ in range(60)]
    rows = S.sql(files(spark, "SQL", *texts)).collect()
    for i, text in enumerate(texts):
        want, _ = plain_statements(text)
        assert [r.content for r in rows if r.file_path == f"f{i}"] == want


def test_stylesheets(spark):
    text = '@import url("a;b.css");\n/* } ; */ a { color: red; }\n.b, .c > d { x: y }\n@media (min-width: 3px) { a { b: c } }\n@keyframes spin { from { x: y } }'
    assert [x[:2] for x in found(S.stylesheet(files(spark, "CSS", text)))] == [("css_import", '@import url("a;b.css")'), ("css_rule", "a"), ("css_rule", ".b, .c > d"), ("css_media_query", "@media (min-width: 3px)"), ("css_keyframes", "spin")]
    text = "$brand: #fff; // a; {\n@mixin button($x) { a: $x; }\n@function spacing($n) { @return $n * 8px; }\n.card-#{$i} { @include button(1); }\n@use 'x';\n@forward 'y'\n"
    assert [x[:2] for x in found(S.stylesheet(files(spark, "SCSS", text)))] == [("scss_variable", "$brand"), ("scss_mixin", "button"), ("scss_function", "spacing"), ("css_rule", ".card-#{$i}"), ("scss_use", "@use 'x'"), ("scss_forward", "@forward 'y'")]
    assert found(S.stylesheet(files(spark, "CSS", "/* a */"))) == [("stylesheet_document", None, [(1, 1)])]


def test_toml(spark):
    text = "title = 'x' # y\n\n[project]\nname = \"\"\"\n[no]\n\"\"\"\n\n[project.dependencies]\na = [\n 1, # ]\n]\n[[servers]]\nhost = 'z\\'\n"
    assert found(S.toml(files(spark, "TOML", text))) == [("toml_property", "title", [(1, 1)]), ("toml_table", "project", [(3, 6)]), ("toml_table", "project.dependencies", [(8, 11)]), ("toml_table_array", "servers", [(12, 13)])]
    for whole in ("x = [1\n", "just words\n", "# only\n"):
        assert found(S.toml(files(spark, "TOML", whole))) == [("toml_document", None, [(1, 1)])]


def test_yaml(spark):
    text = "name: demo\nservices:\n  web:\n    image: x\n\n  db: {a: [1,\n    2]}\n# end\n"
    assert found(S.yaml(files(spark, "YAML", text))) == [("yaml_property", "name", [(1, 1)]), ("yaml_property", "services", [(2, 7)])]
    assert [x[1] for x in found(S.yaml(files(spark, "YAML", "---\nname: a\n---\nname: b\n'x y': true\n")))] == ["doc[1].name", "doc[2].name", "doc[2].x y"]
    assert [x[:2] for x in found(S.yaml(files(spark, "YAML", "- a\n- b: 1\n  c: 2\n")))] == [("yaml_sequence_item", "$[0]"), ("yaml_sequence_item", "$[1]")]
    for whole in ("a: [1, 2\n", "plain text\n"):
        assert found(S.yaml(files(spark, "YAML", whole))) == [("yaml_document", None, [(1, 1)])]


def test_xml(spark):
    text = '<?xml version="1.0"?>\n<project a="x>y">\n  <groupId>g</groupId>\n  <dependencies>\n    <d/>\n  </dependencies>\n</project>'
    assert found(S.xml(files(spark, "XML", text))) == [("xml_element", "project > groupId", [(2, 2), (3, 3)]), ("xml_element", "project > dependencies", [(2, 2), (4, 6)])]
    for whole in ("<a>x</a>", "<a><b></a>", "<a/>", "<a><b/></a><c/>", "<a><b/>&</a>"):
        assert found(S.xml(files(spark, "XML", whole))) == [("xml_document", None, [(1, 1)])]


def test_html(spark):
    text = '<html><head><title>x</title></head>\n<body>\n\n<header id="top">h</header>\n<main class="app shell"><p>a<p>b<ul><li>1<li>2</ul></main><script>"</p>" < 1</script></body></html>'
    assert found(S.html(files(spark, "HTML", text))) == [
        ("html_element", "html > head", [(1, 1)]),
        ("html_element", "html > body > header#top", [(1, 1), (2, 2), (4, 4)]),
        ("html_element", "html > body > main.app.shell", [(1, 1), (2, 2), (5, 5)]),
        ("html_element", "html > body > script", [(1, 1), (2, 2), (5, 5)]),
    ]
    assert [x[1] for x in found(S.html(files(spark, "HTML", '<section id="intro">x</section>')))] == ["section#intro"]
    assert [x[1] for x in found(S.html(files(spark, "JSP", "<html><body>text</body></html>")))] == ["html > body"]
    for whole in ("<main>", "text", "<p>a > b</p>"):
        assert found(S.html(files(spark, "HTML", whole))) == [("html_document", None, [(1, 1)])]


@pytest.mark.parametrize("kind,text", [("json", '"a, [b]: {\\\\" // c'), ("sql", "'a; b\n\"-- c"), ("css", '"a; {b} /* c'), ("scss", "// a; don't {b}"), ("toml", '"""a [b]\n c = d # e')])
def test_strings_and_comments_are_one_lexeme(spark, kind, text):
    """However long: the number of lexemes does not grow with what stands in them."""
    end = "\n" if text.startswith("//") else '"""' if text.startswith('"""') else text[0]
    df = spark.createDataFrame([(text + " a; [b], {c}" * n + end,) for n in (1, 5000)], "content string")
    ran = df.select(F.size(F.regexp_extract_all("content", F.lit(S.LEXEMES[kind]), F.lit(0))).alias("n")).collect()
    assert [r.n for r in ran] == [2, 2] if end == "\n" else [1, 1]


def test_apostrophes_in_scss_comments(spark):
    text = "// don't\na { b: c }\n/* isn't */ d { content: 'x' }"
    assert [x[1] for x in found(S.stylesheet(files(spark, "SCSS", text)))] == ["a", "d"]


def test_html_lets_a_lone_ampersand_pass(spark):
    text = "<html><head><title>a&amp;&</title></head><body><p>b & c &; d&</p></body></html>"
    assert [x[:2] for x in found(S.html(files(spark, "HTML", text)))] == [("html_element", "html > head"), ("html_element", "html > body > p")]
    assert [x[0] for x in found(S.xml(files(spark, "XML", "<a><b>c & d</b></a>")))] == ["xml_document"]


@pytest.mark.parametrize("make", [S.json, S.sql, S.toml, S.yaml, S.xml, S.html, S.stylesheet])
def test_odd_files(spark, make):
    """Blank and null texts, files without a repository, and repeated paths."""
    odd = spark.createDataFrame([(None, "a", "X", None), (None, "a", "X", "  "), (None, None, "X", "?"), ("r", "a", "X", "?"), ("r", "a", "X", "?")], "repository_id string, file_path string, language string, content string")
    assert make(odd.withColumn("chunk", F.lit(1)).withColumn("raw", F.lit(1))).count() == 3
    assert make(odd.limit(0)).count() == 0
