import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeseam.operators import embed as E
from lodeseam.operators import search as S
from lodeseam.operators import state as St
from lodeseam.sources import files as Files

SCHEMA = "question_id int, vector_id string, score double, vector_score double, file_path string, content string"


def chosen(rows, k, weight=0.1, per_file=2):
    """The same choice, step by step."""
    left, out = list(rows), []
    words = lambda r: set(r[5].lower().split())

    def like(a, b):
        union = words(a) | words(b)
        return len(words(a) & words(b)) / len(union) if union else 0.0

    while left and len(out) < k:
        free = [r for r in left if sum(o[4] == r[4] for o in out) < per_file] or left
        best = max(free, key=lambda r: ((1 - weight) * r[2] - weight * max(like(r, o) for o in out) if out else r[2], r[2], r[3], r[1]))
        out.append(best)
        left.remove(best)
    return [r[1] for r in out]


def test_diverse_against_a_model(spark):
    rng = random.Random(3)
    rows = []
    for q in range(12):
        rows += [(q, f"v{i:02}", round(rng.random(), 2), round(rng.random(), 1), rng.choice("abc"), " ".join(rng.choice("wxyz") for _ in range(rng.randint(0, 4)))) for i in range(rng.randint(1, 9))]
    got = S.diverse(spark.createDataFrame(rows, SCHEMA), 4).select("question_id", "vector_id", "place").collect()
    for q in range(12):
        assert [r.vector_id for r in sorted((r for r in got if r.question_id == q), key=lambda r: r.place)] == chosen([r for r in rows if r[0] == q], 4)


def test_topk_and_filter(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(5)], "vector_id int, values array<double>, even int")
    assert [r.vector_id for r in S.topk(rows, [1.0, 0.0], 2, "dotproduct").orderBy("rank").collect()] == [4, 3]
    assert [r.vector_id for r in S.topk(rows, [1.0, 0.0], 2, "euclidean", where={"even": 0}).orderBy("rank").collect()] == [0, 2]
    with pytest.raises(ValueError):
        S.topk(rows, [1.0], 0)


def test_evidence_budget(spark):
    rows = [(1, i, f"S{i}", "f", "Python", "function", None, 1, 2, None, "x" * 100) for i in (1, 2, 3)]
    df = spark.createDataFrame(rows, "question_id int, place int, citation_id string, file_path string, language string, chunk_type string, symbol_name string, symbol_start_line int, symbol_end_line int, source_ranges array<struct<start_line:int,end_line:int>>, content string")
    head = len("[S1]\nfile: f\nlanguage: Python\nchunk_type: function\nsymbol: none\nlines: 1-2\ncontent:\n")
    text = S.evidence(df, budget=2 * head + 150).first().evidence
    assert text.count("[S") == 2 and len(text) == 2 * head + 150
    assert S.evidence(df, budget=head + 100 + 2 + head).first().evidence.count("[S") == 1
    assert S.evidence(df, budget=1).count() == 0


def test_dedupe_keeps_the_first(spark):
    rows = spark.createDataFrame([(1, "f", "s", "a  b"), (2, "f", "s", "a b"), (3, "g", "s", "a b"), (4, "f", None, "a b"), (5, "f", None, " a b")], "rank int, file_path string, symbol_name string, content string")
    assert sorted(r["rank"] for r in S.dedupe(rows).collect()) == [1, 3, 4]


def test_state(spark):
    rows = [("j", 1, "queued", None), ("j", 2, "indexing", 5), ("j", 3, "failed", None), ("k", 1, "ready", 7), ("k", 2, "queued", None)]
    events = spark.createDataFrame(rows, "job string, at int, status string, n int")
    now = {r.job: r for r in St.current(events, "job", ["at"], ("n",)).collect()}
    assert (now["j"].status, now["j"].n, now["k"].status, now["k"].n) == ("failed", 5, "queued", None)
    back = St.recover_interrupted(St.current(events, "job", ["at"]))
    assert {r.job: (r.status, r.recovered) for r in back.collect()} == {"j": ("failed", False), "k": ("failed", True)}


def test_roles(spark):
    messages = spark.createDataFrame([("user",)], "role string")
    assert St.add_messages(messages, spark.createDataFrame([("assistant",)], "role string")).count() == 2
    with pytest.raises(Exception, match="role system"):
        St.add_messages(messages, spark.createDataFrame([("system",)], "role string")).collect()


def test_embed(spark):
    rows = spark.createDataFrame([(1, "alpha beta"), (2, "beta alpha"), (3, None)], "id int, text string")
    got = {r.id: r["values"] for r in E.embed(rows, "text").collect()}
    assert got[1] == got[2] and sum(x * x for x in got[1]) == pytest.approx(1) and set(got[3]) == {0.0}
    with pytest.raises(Exception, match="above the capacity"):
        spark.range(1).select(E.within_capacity(F.lit("a b c"), 2)).collect()


def test_scan(spark, tmp_path):
    for path, data in {"a.py": b"x = 1\r\n", "_b/__init__.py": b"y", ".github/c.py": b"z", "d.py": b"  ", "e.txt": b"t", "f.sh": "é".encode("latin-1"), "g/build": b"b"}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_bytes(data)
    files, counts = Files.scan(spark, str(tmp_path), "r")
    assert {r.relative_path: r.content for r in files.collect()} == {"a.py": "x = 1\n", "_b/__init__.py": "y", "f.sh": "é"}
    got = counts.first()
    assert (got.total_files, got.supported_files, got.ignored_files) == (6, 3, 3)
    assert [(x.language, x.files) for x in got.languages] == [("Python", 2), ("Shell", 1)]


def test_topk_each_answers_any_number_of_questions(spark, monkeypatch):
    """More questions than are broadcast at once get the same answers, in blocks."""
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "vector_id long, values array<double>").repartition(3)
    questions = vectors.where("vector_id % 2 = 0").select(F.col("vector_id").alias("question_id"), F.col("values").alias("wanted"))
    monkeypatch.setattr(S, "MOST_QUESTIONS", 7)
    got = {}
    for r in S.topk_each(vectors, questions, 4).orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append(r.vector_id)
    length = lambda x: sum(a * a for a in x) ** 0.5
    cosine = lambda x, y: sum(a * b for a, b in zip(x, y)) / (length(x) * length(y))
    assert got == {q: [v for v, _ in sorted(rows, key=lambda r: -cosine(r[1], wanted))[:4]] for q, wanted in rows if q % 2 == 0}


@pytest.mark.parametrize("metric", ["cosine", "dotproduct", "euclidean"])
def test_topk_each_scores_as_columns_do(spark, monkeypatch, metric):
    """Products of blocks give the scores, ties and nulls of the columns, in several blocks and parts, for copies, multiples
    and vectors that no product takes."""
    rng = random.Random(5)
    plain = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(150)]
    odd = [None, [], [0.0] * 5, [float("nan")] * 5, [float("inf"), 1.0, 1.0, 1.0, 1.0], [1e-170] * 5, [1e170] * 5, [1.0, None, 1.0, 1.0, 1.0], [1.0, 2.0], [-0.0] * 5]
    values = plain + plain[:30] + [[3 * x for x in v] for v in plain[:20]] + [plain[7]] * 40 + odd + odd
    rng.shuffle(values)
    rows = spark.createDataFrame([(i, f"n{i}", v) for i, v in enumerate(values)], "vector_id long, name string, values array<double>").repartition(3)
    questions = rows.where("vector_id % 3 = 0").select(F.col("vector_id").alias("question_id"), F.col("values").alias("wanted"), F.col("name").alias("asked"))
    monkeypatch.setattr(S, "MOST_QUESTIONS", 40)
    monkeypatch.setattr(S.N, "BLOCK_BYTES", 1000)
    measure, largest = S.V.METRICS[metric]
    score = measure(F.col("values"), F.col("wanted"))
    order = Window.partitionBy("question_id").orderBy(F.desc_nulls_last("vector_score" if largest else -F.col("vector_score")), "vector_id")
    pairs = rows.crossJoin(questions).withColumn("vector_score", score)
    wanted = pairs.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 6").drop("values", "wanted")
    got = S.topk_each(rows, questions, 6, metric)
    assert got.columns == wanted.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, wanted.collect()))


def test_topk_each_multiplies_blocks(spark):
    """The plan holds no comparison of one row and one question; each vector finds itself."""
    rows = spark.range(20_000).select(F.col("id").alias("vector_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(F.col("id") * i + i)).alias("values"))
    questions = rows.where("vector_id % 50 = 0").select(F.col("vector_id").alias("question_id"), F.col("values").alias("wanted"))
    plan = S.topk_each(rows, questions, 5)._jdf.queryExecution().toString()
    assert "zip_with" not in plan and "MapInArrow" in plan
    first = S.topk_each(rows, questions, 5).where("rank = 1").selectExpr("count(*)", "count_if(vector_id = question_id or vector_score > 0.999999)").first()
    assert tuple(first) == (400, 400)
