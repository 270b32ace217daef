import pytest
from pyspark.sql import functions as F

from lodeseam.functions import paths as P
from lodeseam.functions import text as T

ORDER = "How is Order queue implemented?"
FILTER = "How does food price filtering work?"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text,expected",
    [("CustomOrderQueue add_to_queue order-queue", {"custom", "order", "queue", "add", "to"}), ("filtering filtered filters prices categories sorting", {"filter", "price", "category", "sort"}), ("", set()), ("12ab HTTPServer", {"ab", "httpserver"})],
)
def test_tokens(spark, text, expected):
    assert set(one(spark, T.tokens(F.lit(text)))) == expected
    assert set(T.literal_tokens(text)) == expected


CASES = [
    (ORDER, "src/model/CustomOrderQueue.java", "addOrder", "method", "public boolean addOrder(Order order) { orders[rear] = order; }", (1.0, 0.9, 1.0)),
    (ORDER, "src/service/OrderQueueService.java", "getOrderQueue", "method", "public OrderQueue getOrderQueue() {\n  return queue;\n}", (None, None, 0.25)),
    (FILTER, "FoodItemService.java", "filterFoodItems", "method", "return foods.stream().filter(f -> f.getPrice() < max);", (None, None, 1.0)),
    (FILTER, "FoodItemService.java", "sortFoodItemsByPrice", "method", "quickSort(items);", (None, None, 0.1)),
    (FILTER, "foods.jsp", None, "html_document", '<input type="range" name="priceRange" max="500">', (None, None, 1.0)),
    (FILTER, "adminDashboard.jsp", None, "html_document", '<input type="number" name="price"><button class="apply-filter">', (None, None, 0.25)),
]


@pytest.mark.parametrize("query,path,symbol,kind,content,expected", CASES)
def test_scores(spark, query, path, symbol, kind, content, expected):
    q, p, c, k = map(F.lit, (query, path, content, kind))
    s = F.lit(symbol).cast("string")
    got = one(spark, F.array(T.lexical_score(q, c, s, p), T.exact_score(q, s, p), T.structural_score(q, k, s, c)))
    for value, wanted in zip(got, expected):
        assert wanted is None or value == pytest.approx(wanted)


def test_threshold_and_expansion(spark):
    assert one(spark, T.structural_threshold(F.lit("How does the food price filtering work?"))) == 0.45
    assert one(spark, T.structural_threshold(F.lit("Where is the FoodItem model?"))) is None
    text = one(spark, T.query_text(F.lit("How does authentication work?")))
    assert all(w in text for w in ("login", "password", "session"))
    text = one(spark, T.query_text(F.lit("filter foods")))
    assert all(w in text for w in ("input", "parameter", "range", "request", "slider"))
    assert one(spark, T.query_text(F.lit("  Where is the model? "))) == "Where is the model?"


@pytest.mark.parametrize("path,stem", [("a/b.c.md", "b.c"), (".env", ".env"), ("x/name.", "name."), ("x/y/", "y"), ("", ""), ("plain", "plain")])
def test_stem(spark, path, stem):
    assert one(spark, T.file_stem(F.lit(path))) == stem


def test_paths(spark):
    language = lambda p: one(spark, P.language(F.lit(p)))
    assert [language(p) for p in ("Cargo.toml", "pyproject.toml", "login.jsp", "README", "x/A.PY")] == ["TOML", "Python Project Configuration", "JSP", None, "Python"]
    ignored = lambda p: one(spark, P.ignored(F.lit(p)))
    assert [ignored(p) for p in ("build", "build/x.py", "a/.env", "a/b.PNG", "src/x.py")] == [False, True, True, True, False]
    r = one(spark, P.repository_of(F.lit("https://github.com/own/repo.git/")))
    assert (r.owner, r.name) == ("own", "repo")
    valid = lambda u: one(spark, P.repository_url_valid(F.lit(u)))
    assert [valid(u) for u in ("https://github.com/a/b", "https://www.github.com/a/b/", "https://github.com/a", "https://x.com/a/b", "no url")] == [True, True, False, False, False]


def test_jaccard_of_nothing(spark):
    assert one(spark, T.jaccard(T.word_set(F.lit(" ")), T.word_set(F.lit(None).cast("string")))) == 0.0


def test_batches_are_cut_by_bytes():
    """A batch of long rows comes in slices of about the limit; no row is lost, and one long row stays whole."""
    import pyarrow as pa

    from lodeseam.functions.batches import sliced

    texts = ["x" * n for n in (10, 5000, 0, 300, 300, 300)]
    parts = list(sliced([pa.RecordBatch.from_arrays([pa.array(texts)], ["a"])], 1000))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts and all(p.num_rows == 1 or p.nbytes <= 1000 for p in parts) and len(parts) > 2
