"""Writing, replacing and opening an index."""

import pytest

from lodeseam.sources.vector_store import IndexMismatch, VectorStore


def rows(spark, *values):
    return spark.createDataFrame([(n, i, v) for n, i, v in values], "namespace string, id string, values array<double>")


@pytest.fixture
def store(spark, tmp_path):
    return VectorStore.open(spark, f"file://{tmp_path}/index", 2)


def held(store, *names):
    return sorted((r.namespace, r.id, r["values"]) for r in store.read(*names).collect())


def test_namespaces_are_replaced_alone(spark, store):
    assert not store.populated()
    assert store.write(rows(spark, ("a/b:c%", "1", [1.0, 2.0]), ("a/b:c%", "2", [1.0, 2.0]), ("07", "1", [3.0, 4.0]))) == 3
    assert store.write(rows(spark, ("a/b:c%", "3", [5.0, 5.0]))) == 1
    assert held(store) == [("07", "1", [3.0, 4.0]), ("a/b:c%", "3", [5.0, 5.0])] and held(store, "07") == [("07", "1", [3.0, 4.0])]
    store.write(rows(spark, ("07", "1", [9.0, 9.0]), ("07", "2", [9.0, 9.0])), replace=False)
    assert held(store, "07") == [("07", "1", [9.0, 9.0]), ("07", "2", [9.0, 9.0])]
    store.delete("a/b:c%")
    store.delete("never there")
    assert held(store) == held(store, "07")


def test_a_bad_row_leaves_everything(spark, store):
    store.write(rows(spark, ("a", "1", [1.0, 2.0])))
    for bad in (("a", "2", [1.0]), ("a", "2", None), ("a", "2", [1.0, None]), ("a", "2", [1.0, float("inf")]), ("a", "2", [1.0, float("nan")]), (" ", "2", [1.0, 2.0]), (None, "2", [1.0, 2.0]), ("a", "", [1.0, 2.0]), ("a", "7", [0.0, 0.0])):
        with pytest.raises(Exception, match="namespace|vector|twice"):
            store.write(rows(spark, ("a", "7", [0.0, 0.0]), bad))
        assert held(store) == [("a", "1", [1.0, 2.0])]


def test_one_namespace(spark, store):
    store.write(rows(spark, ("a", "1", [1.0, 2.0]), ("b", "1", [1.0, 2.0])))
    with pytest.raises(Exception, match="another namespace"):
        store.replace_namespace("a", rows(spark, ("a", "2", [1.0, 2.0]), ("b", "2", [1.0, 2.0])))
    assert store.replace_namespace("a", rows(spark, ("a", "2", [1.0, 2.0]))) == 1 and [x[1] for x in held(store, "a")] == ["2"]
    assert store.replace_namespace(" a ", rows(spark)) == 0 and held(store, "a") == [] and len(held(store)) == 1
    with pytest.raises(ValueError, match="blank"):
        store.replace_namespace(" ", rows(spark))


def test_opening_checks_dimension_and_metric(spark, store):
    assert VectorStore.open(spark, store.path, 2).dimension == 2
    for dimension, metric in ((3, "cosine"), (2, "euclidean")):
        with pytest.raises(IndexMismatch):
            VectorStore.open(spark, store.path, dimension, metric)
    with pytest.raises(ValueError):
        VectorStore.open(spark, store.path + "2", 2, "manhattan")


def test_batches(spark, store):
    """Three rows at two a batch, and at a bound of bytes that one row alone meets."""
    three = rows(spark, *[("a", str(i), [1.0, 2.0]) for i in range(3)])
    store.write(three, batch_rows=2)
    assert sorted(r.batch for r in store.read().collect()) == [0, 0, 1]
    store.write(three, batch_bytes=10)
    assert sorted(r.batch for r in store.read().collect()) == [0, 1, 2]
