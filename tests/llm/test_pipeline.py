import random
import zlib

import pytest

import corpus_pipeline as pipeline
from lodeseam.llm import packing, secret_scan, shingle_dedup

from .test_dedup import brute_components, brute_fingerprint, plain_normal

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def lines_of(text):
    return [(k, n) for k, line in enumerate((text or "").split("\n")) if (n := plain_normal(line))]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    words = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("aeiou") + rng.choice(["n ", "r ", "st ", "l "]) for _ in range(400)).split()
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts, toxic = {}, {}
    for i in range(160):
        lines = [prose(rng.randint(8, 30)) for _ in range(4)]
        if i % 4 == 0:
            lines[1] += " you idiot moron"
        toxic[i] = int(i % 4 == 0)
        if i % 5 == 1:
            lines.append("this very line stands in many of the documents 12")
        if i % 6 == 1:
            lines.append('token = "%040x" end' % rng.getrandbits(160))
        texts[i] = "\n".join(lines)
    texts[200] = texts[1]
    texts[201] = texts[2] + " x"
    texts[202] = None
    texts[203] = ""
    texts[204] = prose(50) + " you 1d10t and m0ron"
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()] + [(1, texts[1], "en", "s", len(texts[1]))]
    spark.createDataFrame(rows, DOC).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, texts


def test_stages(spark, tables, tmp_path):
    """Each stage against a plain version of it, on what the stage before left."""
    folder, texts = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, held = docs.columns, {}
    for n, (name, stage) in enumerate(pipeline.STAGES):
        before = docs
        out = str(tmp_path / name)
        stage(spark, docs, folder).write.parquet(out)
        docs = spark.read.parquet(out)
        if n < len(pipeline.STAGES) - 1:
            assert docs.columns == columns
        held[name] = (before.collect(), docs.collect())

    before, after = held["toxicity"]
    left = {r.doc_id for r in after}
    assert left == {i for i in texts if not (i < 200 and i % 4 == 0) and i != 204}

    before, after = held["line_dedup"]
    kept = {}
    for r in sorted(before, key=lambda r: r.doc_id):
        for k, normal in lines_of(r.text):
            kept.setdefault(normal, (r.doc_id, k))
    gone = {r.doc_id: {k for k, normal in lines_of(r.text) if kept[normal] != (r.doc_id, k)} for r in before}
    wanted = {r.doc_id: r.text and "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in gone[r.doc_id]) for r in before}
    got = {r.doc_id: r.text for r in after}
    same = [i for i in wanted if got[i] == wanted[i]]
    # 201 is like 2 in one line only, which exact copies don't tell
    assert set(wanted) == set(got) and set(wanted) - set(same) <= {201}

    before, after = held["simhash_near_dedup"]
    group = brute_components({r.doc_id: brute_fingerprint(r.text) for r in before})
    assert sorted(r.doc_id for r in after) == sorted({min(i for i in group if group[i] == g) for g in group.values()})

    before, after = held["secret_scan"]
    got = {r.doc_id: r.text for r in after}
    assert len(after) == len(before)
    for r in before:
        spans = secret_scan.base_spans(r.text or "")
        assert not secret_scan.base_spans(got[r.doc_id] or "")
        assert spans or got[r.doc_id] == r.text or "[SECRET]" in got[r.doc_id]

    before, after = held["packing"]
    model = packing.load(packing.vocabulary_path())
    ids = {r.doc_id: [*model.encode_ordinary(r.text or ""), 0] for r in before}
    assert sum(r.length for r in after) == sum(map(len, ids.values()))
    for r in after:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)) == r.ids_crc32


def test_run(spark, tables):
    packed = pipeline.run(spark, tables[0])
    assert packed.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and packed.count() > 0


@pytest.mark.parametrize("bucket", [8, 4096])
def test_near_copies_of_like_shingles_go(spark, bucket):
    """Copies of similarity 0.8 or more by five-word shingles are found, and no link is made below it."""
    rng = random.Random(31)
    rows, sets = [], {}
    for i in range(120):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)] if i % 4 == 0 else base
        words = list(base)
        for _ in range((0, 2, 3, 9)[i % 4]):
            words[rng.randrange(len(words))] = f"z{rng.randrange(5000)}"
        rows.append((i, " ".join(words), "en", "s", 1))
        sets[i] = {tuple(words[k : k + 5]) for k in range(196)}
    root = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    docs = spark.createDataFrame(rows + [(None, rows[0][1], "en", "s", 1)], DOC)
    got = {r.doc_id: r.component_id for r in shingle_dedup.groups(docs, bucket).collect()}
    assert got.pop(None) is None and got == root and len(set(root.values())) < 120
    left = [r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(i for i in left if i is not None) == sorted(set(root.values())) and None in left


def test_near_copies_by_fingerprints_go(spark):
    """Texts whose fingerprints are at most two bits apart are linked, though their shingles are not alike."""
    phrase = "one phrase of a few words stands here often".split() * 30
    long, found = ([*phrase, *(f"{sign}{i}" for i in range(12))] for sign in "ab")
    assert (brute_fingerprint(" ".join(found)) ^ brute_fingerprint(" ".join(long))).bit_count() <= 2
    sets = [{tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (long, found)]
    assert len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < shingle_dedup.LEAST
    rows = [(3, " ".join(long)), (5, " ".join(found)), (9, "another text of a few words that is like none")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC)
    assert sorted(r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, "").collect()) == [3, 9]


def test_rows_that_repeat_an_id_with_another_text(spark):
    """Every text that stands nowhere else survives the stages that drop; equal rows are one."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    word = lambda a: " ".join(f"{a}{chr(97 + i % 26)}{i}" for i in range(30))
    rows = [(1, word("common"), "en", "s"), (2, word("common"), "en", "s"), (2, word("unique"), "en", "s"), (2, word("unique"), "en", "s"), (None, word("common"), "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(1) for c in ("removed_lines", "own", "row", "keep", "id")})
    lines = corpus_pipeline.drop_lines(spark, df, "")
    assert lines.columns == df.columns and sorted((r.doc_id or 0, r.text) for r in lines.collect()) == sorted([(0, word("common")), (1, word("common")), (2, ""), (2, word("unique")), (2, word("unique"))])
    near = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert near.columns == df.columns and sorted((r.doc_id or 0, r.text) for r in near.collect()) == sorted([(0, word("common")), (1, word("common")), (2, word("unique"))])
