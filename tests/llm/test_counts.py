"""Token counts, whitening and alignment against the libraries, exact numbers and plain loops."""

import hashlib
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodeseam.llm import alignment, packing, token_cache, whitening
from tests.llm.helpers import CLASHES, LONG, ODD, docs, empty

JSON, MODEL, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
MORE = ("digest", "least", "mark", "n_bytes", "n_tokens", "tokenizer", "text_", "d", "i", "x", "high", "low", "held", "pairs", "counts", "row", "n_a", "pair", "docs")
SIGNS = ["<|endoftext|>", "a <|endoftext|>b", "<s> </s> <0x41> <unk>", "▁under", "tab\tand  two\n\n\nlines \r\n", "naïve é ​\x00 end", "0000000000000000", "日本語テキスト😀😀", " lead", "trail ", "'s't 've", "ı İ ß ſ"]
TEXTS = [*ODD, *[(100 + i, t, "en", "s") for i, t in enumerate(SIGNS)]]


def table(spark, rows=TEXTS):
    return docs(spark, rows).withColumns({c: F.lit(7) for c in MORE if c not in CLASHES})


def test_ids_of_the_ranks_are_the_librarys_over_all_code_points():
    tokenizer, ranks = Tokenizer.from_file(JSON), packing.load(packing.vocabulary_path())
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 8192):
        texts = [f"a{chr(c)}1 {chr(c)}{chr(c)}  {chr(c)}!{chr(c)}" for c in points[at : at + 8192]]
        assert [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)] == [ranks.encode_ordinary(t) for t in texts]


# op11


def library_count(path):
    if path.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(model.encode(t))
    tokenizer = Tokenizer.from_file(path)
    return lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("path", [JSON, MODEL, WORDS])
@pytest.mark.parametrize("most_sent", [0, 1000])
def test_counts_are_the_librarys(spark, tmp_path, path, most_sent):
    count = library_count(path)
    got = token_cache.count_tokens(table(spark).repartition(3), str(tmp_path / "cache"), path, limit=100, most_sent=most_sent).collect()
    want = [(r[0], len((r[1] or "").encode()), count(r[1] or ""), count(r[1] or "") > 100) for r in TEXTS]
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((w[0] if w[0] is not None else -1, *w[1:]) for w in want)


def cached(spark, cache):
    return Counter((r.tokenizer, bytes(r.digest)) for r in spark.read.schema(token_cache.SCHEMA).parquet(cache).collect())


def test_only_distinct_misses_are_encoded(spark, tmp_path):
    cache = str(tmp_path / "cache")
    hot = docs(spark, [(i, "one text of many rows" if i % 3 else f"text {i % 7}", "en", "a") for i in range(300)], clashes=False).repartition(5)
    token_cache.count_tokens(hot, cache)
    first = cached(spark, cache)
    assert len(first) == 8 and set(first.values()) == {1}
    token_cache.count_tokens(hot, cache)
    assert cached(spark, cache) == first
    token_cache.count_tokens(hot.unionByName(docs(spark, [(1, "new", "en", "a"), (1, "new", "en", "a"), (1, "other", "en", "a"), (None, "new", "en", "a")], clashes=False)), cache)
    second = cached(spark, cache)
    assert len(second) == 10 and set(second.values()) == {1}
    token_cache.count_tokens(hot, cache, MODEL)
    assert len(cached(spark, cache)) == 18  # another tokenizer has its own


def test_counts_come_from_the_cache(spark, tmp_path):
    """What is stored is believed, once where it is stored twice."""
    cache, rows = str(tmp_path / "cache"), docs(spark, [(1, "kept", "en", "a"), (2, "new words", "en", "a")], clashes=False)
    digest = hashlib.sha256(b"kept").digest()
    for _ in range(2):
        token_cache.append(spark.createDataFrame([(bytearray(digest), 77)], "digest binary, n_tokens long"), cache, token_cache.version(JSON))
    got = {r.doc_id: r.n_tokens for r in token_cache.count_tokens(rows, cache).collect()}
    assert got == {1: 77, 2: library_count(JSON)("new words")}


def test_white_space_is_one_where_the_tokenizer_makes_it_one(spark, tmp_path):
    cache = str(tmp_path / "cache")
    token_cache.count_tokens(docs(spark, [(1, "a  b\n c", "en", "a"), (2, "a b c", "en", "a"), (3, "a\tb c", "en", "a")], clashes=False), cache, WORDS)
    assert len(cached(spark, cache)) == 1


def test_counting_nothing(spark, tmp_path):
    got = token_cache.count_tokens(empty(spark), str(tmp_path / "cache"))
    assert got.count() == 0 and got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit", "digest"]


# op12


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(7) for c in (*CLASHES, *MORE)})


def exact_fit(rows):
    """Distinct x-vectors, sums and the covariance in fractions."""
    good = [(i, [int(np.floor(float(np.float32(c)) * 256)) for c in v]) for i, v, _ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    cov = [[Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit), n**3) for j in range(d)] for i in range(d)]
    return good, n, sums, cov


@pytest.fixture(scope="module")
def some_vectors():
    made = np.random.default_rng(4).normal(size=(400, 8)) * [5, 3, 2, 1, 1, 0.5, 0.1, 0.01] + 1000
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(made)]
    rows += [(1000 + i, rows[3][1], 0) for i in range(150)]
    nan, inf = float("nan"), float("inf")
    return rows + [(2000, None, 0), (2001, [1.0] * 7 + [None], 0), (2002, [nan] * 8, 0), (2003, [inf] + [0.0] * 7, 0), (5, rows[9][1], 0), (None, rows[8][1], 1)]


def test_whitening_against_exact_numbers(spark, some_vectors):
    good, n, sums, cov = exact_fit(some_vectors)
    got = whitening.whiten(vectors(spark, some_vectors).repartition(5)).collect()
    assert Counter((r.vec_id, r.component) for r in got) == Counter((i, k) for i, _ in good for k in (1, 2, 3, 4))
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    deviation = {(i, tuple(x)): sum((n * a - s) ** 2 for a, s in zip(x, sums)) for i, x in good}
    by_id = defaultdict(set)
    for (i, _), d in deviation.items():
        by_id[i].add(d)
    assert all(r.deviation in by_id[r.vec_id] and r.deviation_exact == str(r.deviation) for r in got)
    values, basis = np.linalg.eigh(np.array([[float(c) for c in row] for row in cov]))
    values, basis, trace = values[::-1], basis[:, ::-1], float(sum(cov[k][k] for k in range(8)))
    signs = {}
    for r in got:
        assert abs(r.explained / (values[r.component - 1] / trace) - 1) < 1e-9
    for i, x in good:
        if i is not None and i != 5:
            own = {r.component: r.whitened for r in got if r.vec_id == i}
            for k in range(4):
                want = sum(float(Fraction(a) - Fraction(s, n)) * basis[j, k] for j, (a, s) in enumerate(zip(x, sums))) / np.sqrt(values[k])
                sign = signs.setdefault(k, 1 if own[k + 1] * want > 0 else -1)
                assert abs(own[k + 1] - sign * want) < 1e-8


def test_covariance_keeps_digits_that_plain_doubles_lose():
    """Sums of products far from the origin, against fractions."""
    rng = np.random.default_rng(2)
    x = rng.integers(-(10**12), 10**12, size=(500, 3)) * 1000 + rng.integers(0, 7, size=(500, 3))
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    high, low = whitening.products(*whitening.Space(n, sums).centred(x))
    at = 0
    for i in range(3):
        for j in range(i, 3):
            want = sum(Fraction(n * int(a) - sums[i], n) * Fraction(n * int(b) - sums[j], n) for a, b in zip(x[:, i], x[:, j]))
            assert abs((Fraction(float(high[at])) + Fraction(float(low[at]))) / want - 1) < Fraction(1, 10**27)
            at += 1


def test_error_free_transformations():
    a, b = np.random.default_rng(1).normal(size=(2, 1000)) * 10.0 ** np.random.default_rng(3).integers(-9, 9, (2, 1000))
    for exact, (s, e) in ((lambda x, y: x + y, whitening.two_sum(a, b)), (lambda x, y: x * y, whitening.two_product(a, b))):
        assert all(Fraction(float(s[k])) + Fraction(float(e[k])) == exact(Fraction(float(a[k])), Fraction(float(b[k]))) for k in range(1000))


def test_whitening_of_few_flat_and_mixed_vectors(spark):
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect()
    assert len(one) == 4 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in one)
    mixed = whitening.whiten(vectors(spark, [(1, [1.0, 2.0], 0), (2, [3.0, 1.0], 0), (3, [5.0], 0), (4, [6.0], 0), (5, [], 0), (6, [3.4e38, -3.4e38], 0)])).collect()
    assert Counter(r.vec_id for r in mixed) == {1: 2, 2: 2, 3: 1, 4: 1, 6: 2}
    assert {r.n for r in mixed if r.vec_id in (3, 4)} == {2} and next(r for r in mixed if r.vec_id == 3).deviation == 256**2
    assert all(r.deviation is None and int(r.deviation_exact) > 2**63 for r in mixed if r.vec_id == 6)
    flat = whitening.whiten(vectors(spark, [(i, [float(i), 2.0, float(i * i)], 0) for i in range(9)])).collect()
    assert all((r.whitened is None) == (r.component == 3) for r in flat) and flat[0].identity_error < 1e-9
    assert whitening.whiten(vectors(spark, [])).count() == 0 and whitening.whiten(vectors(spark, [(1, None, 0)])).count() == 0


def test_vectors_too_long_for_the_matrices_are_refused(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MOST_CELLS", 3)
    with pytest.raises(ValueError, match="3 is the most"):
        whitening.whiten(vectors(spark, [(1, [1.0, 2.0], 0)]))


# op13


def plain_alignment(texts):
    """By token, group and link, from the files that the contract names."""
    tokenizer, model = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    tokenizer.encode_special_tokens = True
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(c): c for c in keep} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in keep)}
    out, linked = [], Counter()
    for text in texts:
        a = b = []
        if text:
            e = tokenizer.encode(" " + text, add_special_tokens=False)
            a = [(i, bytes(signs[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
            b = [(i, bytes([int(p[3:5], 16)]) if p.startswith("<0x") and model.is_byte(i) else p.replace("▁", " ").encode()) for i in model.encode(text) for p in [model.id_to_piece(i)]]
            if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
                a = b = []
        ends = [[sum(len(x) for _, x in t[: k + 1]) for k in range(len(t))] for t in (a, b)]
        groups, last = [], (0, 0)
        for cut in sorted(set(ends[0]) & set(ends[1])):
            now = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append(([i for i, _ in a[last[0] : now[0]]], [i for i, _ in b[last[1] : now[1]]]))
            last = now
        links = [(x, y) for g, h in groups for x in g for y in h]
        linked.update(set(links))
        out.append((len(a), len(b), groups, links))
    most = defaultdict(int)
    for (x, _), n in linked.items():
        most[x] = max(most[x], n)
    name = lambda groups: hashlib.sha256(";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups).encode()).hexdigest() if groups else ""
    return [(n, m, len(g), len(links), sum(linked[p] == most[p[0]] for p in links), sum(linked[p] for p in links), name(g)) for n, m, g, links in out]


def made_texts():
    rng = random.Random(5)
    parts = [*SIGNS, *"the cat sat on mats with éclairs, naïve Ünïcode 日本 語 😀 12345 --- don't https://x.org/a_b?c=1 \n \n\n \t".split(" "), "   "]
    return [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(60)]


@pytest.mark.parametrize("most_sent", [1_000_000, 150])
def test_alignment_against_plain_loops(spark, most_sent, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE", 700)
    rows = [*[r for r in TEXTS if r[1] != LONG], *[(200 + i, t, "en", "s") for i, t in enumerate(made_texts())], (300, "copy " * 500, None, None), (301, "copy " * 500, None, None)]
    got = alignment.align(table(spark, rows).repartition(3), most_sent=most_sent).collect()
    want = [(r[0] if r[0] is not None else -1, *w) for r, w in zip(rows, plain_alignment([r[1] for r in rows]))]
    assert sorted((r.doc_id if r.doc_id is not None else -1, *r[1:]) for r in got) == sorted(want)
    assert any(w[1] == 0 for w in want) and any(w[3] < w[4] for w in want)


def test_links_are_the_same_in_small_parts(monkeypatch):
    texts = [t for t in made_texts() if "▁" not in t] + ["0" * 300, "", None]
    whole = [(x[:5], x[5].tolist(), x[6].tolist()) for x in alignment.Aligner(packing.vocabulary_path(), MODEL).documents(texts)]
    monkeypatch.setattr(alignment, "MOST_LINKS", 3)
    assert [(x[:5], x[5].tolist(), x[6].tolist()) for x in alignment.Aligner(packing.vocabulary_path(), MODEL).documents(texts)] == whole


def test_counts_of_a_task_in_small_parts(spark, monkeypatch):
    rows = [(i, t, "en", "s") for i, t in enumerate(made_texts())]
    want = sorted(map(tuple, alignment.align(docs(spark, rows)).collect()))
    monkeypatch.setattr(alignment, "SLICE", 500)
    monkeypatch.setattr(alignment, "GATHERED", 40)
    assert sorted(map(tuple, alignment.align(docs(spark, rows)).collect())) == want


def test_packed_bits():
    rng = np.random.default_rng(6)
    for size in (1, 63, 64, 65, 1000):
        ends = np.unique(np.append(rng.integers(1, size + 1, size // 3 + 1), size))
        words = alignment.bit_marks(ends, size)
        assert alignment.selected(words).tolist() == ends.tolist()
        assert alignment.Ranks(words)(np.arange(1, size + 1)).tolist() == [int((ends <= e).sum()) for e in range(1, size + 1)]
    pairs, times = np.array([3, 2**31 - 1, 2**40]), np.array([1, 5, 2**33])
    assert all((x == y).all() for x, y in zip(alignment.unpress(alignment.press(pairs, times)), (pairs, times)))


def test_aligning_nothing(spark):
    assert alignment.align(empty(spark)).count() == 0
    long = alignment.align(docs(spark, [(1, LONG, "en", "a"), (2, None, "en", "a")])).collect()
    assert sorted((r.doc_id, r.n_a > 0, r.groups_sha256 != "") for r in long) == [(1, True, True), (2, False, False)]
