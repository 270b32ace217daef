import random

from lodeseam.llm import common


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(20)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_components_of_nothing(spark):
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_filter_has_no_misses(spark):
    keys = spark.range(0, 1000, 7)
    words = common.bloom_words(keys, "id", 1 << 12)
    assert words.count() <= (1 << 12) / 64
    hit = common.maybe_in(spark.range(1000), "id", words, 1 << 12)
    assert hit.where("id % 7 = 0 and not __maybe").count() == 0
    assert 0 < hit.where("not __maybe").count()


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    """A path of 4096 nodes in shuffled order, cut up so that no task joins more than two of its links."""
    rounds = []
    settle = common.settle
    monkeypatch.setattr(common, "settle", lambda df: rounds.append(1) or settle(df))
    ids = list(range(4096))
    random.Random(3).shuffle(ids)
    monkeypatch.setattr(common, "local_forest", lambda batches: batches)
    got = common.components(spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long").selectExpr("greatest(a, b) a", "least(a, b) b")).collect()
    assert len(got) == 4096 and {r.component for r in got} == {0}
    assert len(rounds) <= 1 + 2 * 20


def test_local_forest_joins_what_links_join():
    import pyarrow as pa

    rng = random.Random(5)
    links = [(rng.randint(0, 99), rng.randint(0, 99)) for _ in range(80)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])
    stars = [(r["a"], r["b"]) for b in common.local_forest([batch]) for r in b.to_pylist()]

    def groups(edges):
        root = list(range(100))
        for a, b in edges:
            a, b = sorted((root[a], root[b]))
            root = [a if r == b else r for r in root]
        return root

    assert groups(stars) == groups(links) and all(a > b for a, b in stars)


def test_bit_filter_has_no_misses(spark):
    import numpy as np

    held = common.filter_bits(spark.range(-500, 500, 7), "id", 1 << 12)
    ids = np.arange(-500, 500)
    hit = common.in_filter(held, ids)
    assert hit[::7].all() and not hit.all()
