import pytest
from pyspark.sql import functions as F

from lodeseam.operators import chunks as C
from lodeseam.operators import structured as S
from lodeseam.operators import windows as W
from lodeseam.operators.markdown import headings, markdown


def files(spark, language, *texts):
    return spark.createDataFrame([("r", f"f{i}", language, t) for i, t in enumerate(texts)], "repository_id string, file_path string, language string, content string")


def found(df, order="symbol_start_line"):
    return [(r.chunk_type, r.symbol_name, [(x.start_line, x.end_line) for x in r.source_ranges]) for r in df.orderBy("file_path", order).collect()]


def test_markdown(spark):
    text = "---\ntitle: x\n---\nintro\n# Guide\ntext\n\n## Setup\nrun\n### Windows\n```\n# no\n```\nmore\n## Usage\nend"
    assert found(markdown(files(spark, "Markdown", text))) == [
        ("markdown_preamble", None, [(1, 4)]),
        ("markdown_section", "Guide", [(5, 6)]),
        ("markdown_section", "Guide > Setup", [(5, 5), (8, 9)]),
        ("markdown_section", "Guide > Setup > Windows", [(5, 5), (8, 8), (10, 14)]),
        ("markdown_section", "Guide > Usage", [(5, 5), (15, 16)]),
    ]


def test_markdown_setext_and_plain(spark):
    text = "Project Guide\n=====\ntext\nInstallation\n----\nrun\n## C#\nend"
    assert [n for _, n, _ in found(markdown(files(spark, "Markdown", text)))] == ["Project Guide", "Project Guide > Installation", "Project Guide > C#"]
    assert found(markdown(files(spark, "Markdown", "a\nb\nc"))) == [("markdown_document", None, [(1, 3)])]
    assert found(markdown(files(spark, "Markdown", ""))) == []


def test_unclosed_fence_hides_the_rest(spark):
    assert headings(files(spark, "Markdown", "# A\n~~~\n# B\n```\n# C")).count() == 1
    assert headings(files(spark, "Markdown", "````\n# A\n```\n# B\n`````\n# C")).count() == 1


CODE = (
    ("Python", "class Service:\n    value = 1\n    def __init__(self): pass\n    async def run(self):\n        def helper(): pass\n        return helper()\n", "class_context Service, constructor __init__, method run, function helper"),
    ("Java", "record User(int id) {} interface Api { void run(); } class App { App() {} void go() {} }", "record_context User, interface_context Api, method run, class_context App, constructor App, method go"),
    ("JavaScript", "export const App = () => <View />;\nconst schema = new Schema({x: 1});\nconst login = function () { return true; };\nclass User { constructor() {} save() { const local = {}; } }\n", "function App, declaration schema, function login, class_context User, constructor constructor, method save"),
    ("TypeScript", "interface User { id: number } type ID = string; export const run = (): void => {}; class A { constructor() {} m(): void {} }", "interface_context User, type_alias ID, function run, class_context A, constructor constructor, method m"),
    ("C", "struct User { int id; }; enum Role { ADMIN }; int run(int x) { return x; }", "struct_context User, enum_context Role, function run"),
    ("C++", "namespace api { class User { public: User() {} void run() {} }; struct Data { int x; }; }", "namespace_context api, class_context User, constructor User, method run, struct_context Data"),
    ("C#", "namespace App; public record User(int Id); interface IRun { void Run(); } class A { A() {} void Go() {} }", "namespace_context App, record_context User, interface_context IRun, method Run, class_context A, constructor A, method Go"),
    ("Go", "type User struct { ID int }; type Runner interface { Run() }; func NewUser() User { return User{} }; func (u User) Run() {}", "struct_context User, interface_context Runner, function NewUser, method Run"),
    ("Rust", "mod api { trait Run { fn run(&self); } struct User { id: i32 } enum Role { Admin } impl Run for User { fn run(&self) {} } }", "module_context api, trait_context Run, struct_context User, enum_context Role, impl_context User, method run"),
    ("PHP", "<?php namespace App; trait T { public function t() {} } interface I { public function x(); } class A { public function __construct() {} public function x() {} } function top() {}", "namespace_context App, trait_context T, method t, interface_context I, method x, class_context A, constructor __construct, method x, function top"),
    ("Ruby", "class User\n def initialize; end\n def run; end\n def self.build; end\nend", "class_context User, constructor initialize, method run, method build"),
    ("Kotlin", "class User { fun run() {} }\nenum class Role { ADMIN }", "class_context User, method run, enum_context Role"),
    ("Swift", "protocol Run { func run() } struct User { init() {} func run() {} } class App { func go() {} } enum Role { case admin } extension User { func extra() {} }", "protocol_context Run, struct_context User, constructor init, method run, class_context App, method go, enum_context Role, extension_context User, method extra"),
    ("Shell", "function build() { echo ok; }\nrun() { echo run; }", "function build, function run"),
    ("Java", 'import x.y;\n\npublic class Queue {\n    private int rear; // Front; {\n    String s = "}";\n\n    public boolean add(Order order,\n        int n) {\n        if (n > 1) { return foo(() -> { return 1; }); }\n        return true;\n    }\n}\n', "class_context Queue, method add"),
    ("Python", 'class Store(Base):\n    """doc\n    def no(): pass\n    """\n    size = 3\n\n    @property\n    def load(\n        self,\n    ):\n        return 1\n\n\ndef main():\n    return 2\n', "class_context Store, method load, function main"),
    ("Go", "", ""),
    ("Python", "x = 1\n", ""),
)


def test_code(spark):
    rows = [("r", f"{i:02}", language, text) for i, (language, text, _) in enumerate(CODE)]
    df = spark.createDataFrame(rows, "repository_id string, file_path string, language string, content string")
    got = C.declarations(df).collect()
    for i, (_, _, wanted) in enumerate(CODE):
        assert ", ".join(f"{r.chunk_type} {r.symbol_name}" for r in got if r.file_path == f"{i:02}") == wanted
    of = {(r.file_path, r.symbol_name): ([tuple(x) for x in r.source_ranges], r.content) for r in got}
    assert of["14", "Queue"] == ([(3, 3), (4, 4), (5, 5)], 'public class Queue\n\nprivate int rear\n\nString s = "}"')
    assert of["14", "add"][0] == [(7, 11)] and of["14", "add"][1].endswith("return true;\n    }")
    assert of["15", "Store"] == ([(1, 1), (2, 4), (5, 5)], 'class Store(Base):\n\n"""doc\n    def no(): pass\n    """\n\nsize = 3') and of["15", "load"][0] == [(8, 11)]


def test_descriptor(spark):
    got = spark.range(1).select(*[S.descriptor(F.lit(x)) for x in ('<main id="m" class="app  shell">', "<A href=x id=b>", "<p data-id='c'>")]).first()
    assert tuple(got) == ("main#m.app.shell", "A#b", "p")


def test_router_falls_back(spark):
    assert found(C.route(files(spark, "Dockerfile", "FROM x\nRUN y"))) == [("dockerfile", None, [(1, 2)])]
    assert found(C.route(files(spark, "JSON", "[1, 2"))) == [("json_document", None, [(1, 1)])]
    assert found(C.route(files(spark, "Python", "x = 1"))) == []


def chunk(spark, text, ranges):
    rows = [("r", "f", "Python", "function", "s", ranges[0][0], ranges[-1][1], [{"start_line": a, "end_line": b} for a, b in ranges], text)]
    return spark.createDataFrame(rows, "repository_id string, file_path string, language string, chunk_type string, symbol_name string, symbol_start_line int, symbol_end_line int, source_ranges array<struct<start_line:int,end_line:int>>, content string")


def test_windows(spark):
    text = "\n".join(f"line {i}: {'x' * 20}" for i in range(10))
    parts = W.split(chunk(spark, text, [(10, 19)]), 80, 15).orderBy("part").collect()
    assert len(parts) > 1 and all(len(p.content) <= 80 for p in parts)
    assert all(10 <= r.start_line <= r.end_line <= 19 for p in parts for r in p.source_ranges)
    assert {n for p in parts for r in p.source_ranges for n in range(r.start_line, r.end_line + 1)} == set(range(10, 20))
    assert all(p.symbol_start_line == 10 and p.symbol_end_line == 19 for p in parts)
    parts = W.split(chunk(spark, "x" * 240, [(7, 7)]), 80, 10).collect()
    assert all([(r.start_line, r.end_line) for r in p.source_ranges] == [(7, 7)] for p in parts)
    assert W.split(chunk(spark, "short", [(1, 1)]), 80, 10).first().content == "short"


@pytest.mark.parametrize("most,overlap", [(0, 0), (10, -1), (10, 10)])
def test_window_sizes(most, overlap):
    with pytest.raises(ValueError):
        W.check_sizes(most, overlap)


def test_offsets_cover_and_move_on():
    import random

    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice("ab ;\n\n{}") for _ in range(rng.randint(0, 200)))
        got = W.offsets(text, 20, 6)
        assert not got or (got[0][0] == 0 and got[-1][1] == len(text))
        assert all(b[0] > a[0] and b[0] <= a[1] and a[1] - a[0] <= 20 for a, b in zip(got, got[1:]))


def test_batches(spark):
    rows = spark.createDataFrame([("k", i, n) for i, n in enumerate([10, 10, 90, 5, 200, 1])] + [("l", 0, 1)], "key string, at int, size int")
    got = {(r.key, r["at"]): r.batch for r in W.batches(rows, "key", ["at"], "size", 2, 100).collect()}
    assert [got["k", i] for i in range(6)] == [0, 0, 1, 1, 2, 3] and got["l", 0] == 0


@pytest.mark.parametrize(
    "text,ranges,lines",
    [
        ("a\nb\n\n\nc\nd", [(10, 11), (20, 21)], [10, 11, None, None, 20, 21]),
        ("a\n\nb\n\nc", [(1, 3), (9, 9)], [1, 2, 3, None, 9]),
        ("a\nb\nc", [(4, 5)], [4, 5, 5]),
        ("a", [(7, 9)], [7]),
        ("", [], [None]),
        ("a\n \nb\n\t\nc", [(1, 1), (5, 5), (9, 9)], [1, None, 5, None, 9]),
    ],
)
def test_line_map(text, ranges, lines):
    assert W.line_map(text, ranges) == lines


def test_windows_of_joined_ranges():
    """A parent's heading and a section: every window's lines come from the two ranges."""
    text = "# Parent\n\n## Child\n" + "\n".join(f"detail {i}" for i in range(8))
    parts = W.windows_of(text, [(1, 1), (5, 13)], 70, 10)
    assert len(parts) > 1 and all(len(p) <= 70 for p, _ in parts)
    assert {n for _, r in parts for a, b in r for n in range(a, b + 1)} == {1, *range(5, 14)}


def test_ranges_of_lines(spark):
    rows = spark.createDataFrame([("a", n) for n in (1, 2, 2, 3, 7, 9, 10)], "f string, n int")
    assert sorted((r.start_line, r.end_line) for r in C.ranges_of_lines(rows, ("f",), "n").collect()) == [(1, 3), (7, 7), (9, 10)]
