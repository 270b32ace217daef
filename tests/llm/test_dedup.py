import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lodeseam.llm import exact_dedup, line_dedup, simhash_dedup, substring_dedup

from .helpers import LONG, ODD, SCHEMA, docs, empty

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("bits", [64, 1 << 20])
def test_exact(spark, bits):
    """A full filter gives the same rows."""
    rows = ODD + [(i, f"text {i % 5}", "en", "s") for i in range(20, 60)]
    got = exact_dedup.mark_exact(docs(spark, rows), bits).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(lower(t), []).append(i)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        assert (r.keep_id, r.group_size, r.kept) == (max((i for i in ids if i is not None), default=None), len(ids), r.doc_id == r.keep_id)
    assert exact_dedup.mark_exact(empty(spark)).count() == 0
    assert exact_dedup.drop_exact(docs(spark)).where("doc_id in (1, 2)").count() == 0


def test_exact_drops_rows_and_not_ids(spark):
    """Rows without an id, and others of a repeated id, stay if their own texts do."""
    rows = [(None, "same", "en", "s"), (None, "alone", "en", "s"), (5, "Same", "en", "s"), (5, "other", "en", "s"), (9, "OTHER", "en", "s"), (3, "third", "en", "s")]
    kept = exact_dedup.drop_exact(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "alone"), (3, "third"), (5, "Same"), (9, "OTHER")]


def brute_fingerprint(text, k=3):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(marks, bits=2):
    ids = [i for i in marks if i is not None]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if j < i and (marks[i] ^ marks[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("bucket", [4, 4096])
def test_simhash(spark, bucket):
    """Small buckets are cut in parts and lose no link."""
    rng = random.Random(4)
    base = " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(300)).split()
    rows = list(ODD)
    for i in range(100, 160):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "zz"
        rows.append((i, " ".join(words), "en", "s"))
    got = simhash_dedup.groups(docs(spark, rows), bucket=bucket).collect()
    marks = {i: brute_fingerprint(t) for i, t, *_ in rows}
    wanted = brute_components(marks)
    assert len(got) == len(rows)
    for r in got:
        assert r.fp & (2**64 - 1) == marks[r.doc_id]
        assert r.component_id == (wanted[r.doc_id] if r.doc_id is not None else None)
    assert simhash_dedup.groups(empty(spark)).count() == 0


def test_gray_index_finds_all():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(6)]))
    codes = codes[np.argsort(simhash_dedup.gray_rank(codes), kind="stable")]
    for bits in (0, 1, 2, 5):
        query, place = simhash_dedup.GrayIndex(codes).near(codes, bits)
        wanted = {(i, j) for i in range(len(codes)) for j in range(len(codes)) if (int(codes[i]) ^ int(codes[j])).bit_count() <= bits}
        assert set(zip(query.tolist(), place.tolist())) == wanted


def test_substring(spark):
    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "Ünï"]
    shared = [rng.choice(words) for _ in range(40)]
    rows = list(ODD)
    for i in range(50, 110):
        text = [rng.choice(words) + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 60))]
        at = rng.randint(0, len(text))
        rows.append((i, " \t".join(text[:at] + shared[rng.randint(0, 20) : rng.randint(20, 40)] + text[at:]), "en", "s"))
    first, wanted = {}, {}
    lists = {i: WORD.findall(t or "") for i, t, *_ in rows if i is not None}
    for i in sorted(lists):
        for k in range(len(lists[i]) - 12):
            first.setdefault(tuple(lists[i][k : k + 13]), i)
    for i, ws in lists.items():
        gone = {k + j for k in range(len(ws) - 12) if first[tuple(ws[k : k + 13])] < i for j in range(13)}
        wanted[i] = (len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone))
    got = substring_dedup.remove_repeats(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_words, r.n_removed, r.kept_text) == wanted[r.doc_id]
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


def test_repeats_inside_a_document_across_slices(spark):
    """Every place of a passage goes that a smaller doc_id in another partition holds."""
    passage = " ".join(f"p{k}" for k in range(15))
    rows = [(1, f"a1 {passage} a2", "en", "s"), (2, f"b1 {passage} b2 {passage} b3", "en", "s"), (3, f"{passage} c1 c2 {passage} {passage}", "en", "s")]
    df = spark.createDataFrame(rows, SCHEMA).repartitionByRange(3, "doc_id")
    assert df.rdd.getNumPartitions() == 3
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(df).collect()}
    assert got == {1: (0, rows[0][1]), 2: (30, "b1 b2 b3"), 3: (45, "c1 c2")}


def test_windows_with_one_hash_are_told_apart():
    words = substring_dedup.Words([b"a b c d".split(), b"a b c e".split(), b"a b c d".split()])
    places = words.windows(4)
    least, first = substring_dedup.owners(words, places, np.zeros(3, np.uint64), np.array([7, 1, 9]), 4)
    assert least.tolist() == [7, 1, 7] and first.tolist() == [True, True, False]


def test_hot_minimisers_change_no_result(spark):
    rows = [(i, f"start{i} " + "one two three four five six seven eight nine ten eleven twelve thirteen fourteen" + f" end{i} x{i} y{i}", "en", "s") for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text")
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(df).collect()} == {i: 14 * (i > 0) for i in range(30)}


def test_lines(spark):
    a, b, c = "One two, three four FIVE six 7 eight nine ten", "one two three four five six 8 eight nine ten!", "one two three four five six 8 eight nine tan"
    rows = [(1, f"{a}\nshort line\nother words stand in this line here", "en", "s"), (2, f"{b}\nshort LINE", "en", "s"), (3, f"x\n{c}\nsomething else entirely is written here", "en", "s"), (4, None, None, None), (5, "", "en", "s"), (6, f"{a}\n{a}\n--\n--", "en", "s"), (None, a, "en", "s"), (7, LONG, "en", "s")]
    got = {r.doc_id: (r.text, r.removed_lines) for r in line_dedup.remove_lines(docs(spark, rows)).collect()}
    assert got[1] == (rows[0][1], None)
    assert got[2] == ("", [0, 1])
    assert got[6] == ("--\n--", [0, 1])
    assert got[None] == (a, None) and got[4] == (None, None) and got[5] == ("", None) and got[7] == (LONG, None)
    assert got[3] == ("x\nsomething else entirely is written here", [1])
    assert line_dedup.remove_lines(empty(spark)).count() == 0


def test_lines_of_rows_that_repeat_an_id(spark):
    """Rows of one doc_id with different texts are documents of their own: a line goes only where it stands elsewhere."""
    rows = [(1, "a common line of words here", "en", "s"), (2, "a common line of words here", "en", "s"), (2, "this unique line is nowhere else", "en", "s"), (2, "this unique line is nowhere else", "en", "s")]
    got = sorted((r.doc_id, r.text) for r in line_dedup.remove_lines(docs(spark, rows)).collect())
    assert got == [(1, "a common line of words here"), (2, ""), (2, "this unique line is nowhere else"), (2, "this unique line is nowhere else")]


NAMES = ("__doc", "__slot", "__word", "__mask", "__maybe", "__id", "removed_lines", "__gone_id", "__gone_text", "__own_text", "own", "row", "lines", "of", "of_own", "id", "gone_id", "gone_text", "own_id", "own_text", "a.b", "stretches", "text_sha256")


def test_clashing_names(spark):
    from pyspark.sql import functions as F

    rows = docs(spark).withColumns({c: F.lit(1) for c in NAMES})
    cut = line_dedup.remove_lines(rows)
    assert cut.columns == [*(c for c in rows.columns if c != "removed_lines"), "removed_lines"] and cut.count() == rows.count()
    assert exact_dedup.drop_exact(rows).columns == rows.columns and exact_dedup.drop_exact(rows).count() == exact_dedup.mark_exact(rows).where("kept").select("doc_id", "text_sha256").count()
    assert substring_dedup.remove_repeats(rows).count() == rows.count()


def test_windows_of_rows_that_repeat_an_id(spark):
    """Each row loses what its own windows say; rows of one doc_id take nothing from each other."""
    word = lambda a: " ".join(f"{a}{i}" for i in range(15))
    rows = [(1, word("a"), "en", "s"), (2, word("a"), "en", "s"), (2, word("b"), "en", "s"), (2, word("b"), "en", "s"), (3, word("c"), "en", "s"), (3, word("c") + " x", "en", "s")]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs(spark, rows).repartition(3)).collect())
    assert got == [(1, 15, 0), (2, 15, 0), (2, 15, 0), (2, 15, 15), (3, 15, 0), (3, 16, 0)]


def plain_normal(line):
    return " ".join("".join(c if ord(c) > 127 or c.isalpha() else "0" if c.isdigit() else " " for c in line.lower()).split())


def test_normalised_lines_of_odd_texts():
    texts = [t or "" for _, t, *_ in ODD] + ["", "\n\n a  b_c\t12 \n", "\nÉtÉ 3%\r\n\n日本 語", "x", "\n"]
    lines = line_dedup.Lines(texts)
    got = [(int(d), int(k), lines.normal(i), int(size)) for i, (d, k, size) in enumerate(zip(lines.text, lines.number, lines.size))]
    wanted = [(d, k, n, len(n)) for d, t in enumerate(texts) for k, line in enumerate(t.split("\n")) if (n := plain_normal(line))]
    assert got == wanted
    by_node = {}
    for node, (_, _, normal, _) in zip(lines.node.tolist(), got):
        by_node.setdefault(node, set()).add(normal)
    assert all(len(x) == 1 for x in by_node.values()) and len(by_node) == len({x[2] for x in got})


def keys_of(texts):
    lines = line_dedup.Lines(texts)
    line, key = line_dedup.all_keys(lines, np.ones(len(lines.n), bool))
    return [set(key[line == i].tolist()) for i in range(len(lines.n))]


def test_blocks_meet_by_pigeonhole():
    """Lines of b blocks share one wherever fewer than b words are replaced, and where a word is put in or left out."""
    rng = random.Random(8)
    for n in (4, 7, 8, 9, 19, 20, 25, 26, 40, 50, 100, 200, 700, 1700):
        width = next(w for w, least in reversed(line_dedup.WIDTHS) if n >= least)
        words = [f"w{rng.randrange(9999)}" for _ in range(n)]
        for _ in range(10):
            other = list(words)
            for i in rng.sample(range(n), max(1, min(n // width - 1, n // 10))):
                other[i] = f"v{rng.randrange(9999)}"
            longer = list(words)
            longer.insert(rng.randrange(n), "more")
            a, b, c = keys_of([" ".join(x) for x in (words, other, longer)])
            assert a & b
            assert a & c
    a, b, c = keys_of(["日本語のとても長い行には空白がまったくないのでここでは文字で切る一二三四五", "日本語のとても長い行には空白がまったくないのでここでは文学で切る一二三四五", "three short words"])
    assert a & b and not c


def test_line_fingerprints():
    rng = random.Random(13)
    hashes = np.array([rng.getrandbits(64) for _ in range(600)], np.uint64)
    for width in (1, 2, 3, 5, 80, 160, 255):
        got = line_dedup.simhash(line_dedup.bit_sums(hashes), np.array([0, 7, 300]), width)
        bits = np.unpackbits(got.view(np.uint8).reshape(3, 8), axis=1)
        for row, start in zip(bits, (0, 7, 300)):
            counts = [sum(int(h) >> (8 * b + k) & 1 for h in hashes[start : start + width]) for k in range(8) for b in range(8)]
            assert row.tolist() == [int(2 * c > width) for c in counts]


def plain_groups(lines, least=0.8):
    """Groups of equal or edit-similar lines by all pairs."""
    root = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            longer = max(len(lines[i]), len(lines[j]))
            most = int(longer * (1 - least) + 1e-9)
            if root[i] != root[j] and (lines[i] == lines[j] or (abs(len(lines[i]) - len(lines[j])) <= most and line_dedup.edits(lines[i], lines[j], most) <= most)):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def test_few_edits_is_the_edit_distance():
    rnd = random.Random(3)
    for length in (1, 3, 63, 64, 65, 130, 300):
        base = "".join(rnd.choice("abcde ") for _ in range(length))
        texts = [base]
        for _ in range(12):
            own = list(base)
            for _ in range(rnd.randrange(max(2, length // 3))):
                k = rnd.randrange(len(own))
                own[k : k + rnd.randrange(2)] = rnd.choice("abcde ") * (rnd.random() < 0.7 or len(own) == 1)
            texts.append("".join(own))
        held = line_dedup.Texts(texts)
        q, j = np.nonzero(np.triu(np.ones((len(texts), len(texts))), 1))
        order = np.argsort(held.length[j], kind="stable")
        q, j = q[order], j[order]
        own, which = np.unique(q, return_inverse=True)
        real = np.array([line_dedup.edits(texts[a], texts[b], 10**6) for a, b in zip(q, j)])
        for shift in (-1, 0, 3):
            most = np.maximum(real + shift, np.abs(held.length[q] - held.length[j]))
            got = line_dedup.few_edits(*held.table(own, which), held.length[q], held.part(j, 0 * j, int(held.length[j].max())), held.length[j], most)
            assert (got == (real <= most)).all()


def test_alike_links_join_what_pairs_join():
    rng = random.Random(12)
    texts = ["".join(rng.choice("abcd ") for _ in range(40)) for _ in range(6)]
    texts += [t[:i] + "z" + t[i + 1 :] for t in texts for i in rng.sample(range(40), 12)]
    rng.shuffle(texts)
    texts = [" ".join(t.split()) for t in texts]
    size = np.array([len(t) for t in texts], np.int32)
    for bucket in (np.zeros(len(texts), np.int64), np.arange(len(texts)) // 20):
        links = list(line_dedup.alike_links(bucket, size, np.zeros(len(texts), np.uint64), texts, 0.8))
        assert len(links) < len(texts)
        root = list(range(len(texts)))
        for a, b in links:
            a, b = sorted((root[a], root[b]))
            root = [a if r == b else r for r in root]
        wanted = list(range(len(texts)))
        for k in set(bucket.tolist()):
            own = np.flatnonzero(bucket == k).tolist()
            for i, g in zip(own, plain_groups([texts[i] for i in own])):
                a, b = sorted((wanted[i], wanted[own[g]]))
                wanted = [a if r == b else r for r in wanted]
        # equal texts in two buckets are one
        assert all(root[i] == root[j] for i in range(len(texts)) for j in range(i) if wanted[i] == wanted[j])


def test_lower_bounds_of_edits():
    rng = random.Random(14)
    texts = ["".join(rng.choice("abcdé ") for _ in range(rng.choice((3, 30, 64, 65, 130, 200, 330)))) for _ in range(60)]
    for t in texts[:20]:
        other = list(t)
        for _ in range(len(t) // 8 + 1):
            other[rng.randrange(len(t))] = rng.choice("abz")
        texts.append("".join(other[rng.randint(0, 2) :]))
    held = line_dedup.Texts(texts)
    q, j = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    real = np.array([line_dedup.edits(texts[a], texts[b], 10**6) for a, b in zip(q.tolist(), j.tolist())])
    for most in (real, real + 3, np.full(len(q), 40)):
        near = held.near(q, j, most)
        assert near[real <= most].all()
    assert not held.near(q, j, np.maximum(real // 4, 1))[real > 8].all()


def test_long_lines_send_no_short_ones_to_the_exact_test():
    """Pairs go through the table of edits by like lengths; what it says of plain texts is exact, and joins without a test."""
    rng = random.Random(15)
    words = ["".join(rng.sample("abcdefgh", 6)) for _ in range(40)]
    texts = [" ".join(rng.sample(words, 9)) for _ in range(30)] + [" ".join(rng.choice(words) for _ in range(1200)) for _ in range(3)]
    texts += [t[:-1] + "z" for t in texts[:5]] + [texts[0][:-1] + "\u0161"]
    held = line_dedup.Texts(texts)
    q, j = np.nonzero(np.abs(held.length[:, None] - held.length[None]) < 10)
    q, j = q[q > j], j[q > j]
    most = (0.2 * np.maximum(held.length[q], held.length[j])).astype(np.int64)
    near, sure = held.few(q, j, most)
    short = held.length[q] < 100
    real = np.array([line_dedup.edits(texts[a], texts[b], int(m)) <= m for a, b, m in zip(q[short].tolist(), j[short].tolist(), most[short].tolist())])
    assert 0 < real.sum() < len(real) and (near[short] == real).all() and near[~short].all() and not sure[~short].any()
    odd = np.array(["\u0161" in texts[a] + texts[b] for a, b in zip(q[short].tolist(), j[short].tolist())])
    assert (sure[short] == (real & ~odd)).all() and (real & odd).any()
    assert not held.near(q, j, most)[short][~real].any()


def test_early_parting_is_that_of_the_walk():
    rng = random.Random(16)
    words = [w for a in "abc" for w in (a, a * 2, a + "b")]
    seen = set()
    for _ in range(3000):
        a = [rng.choice(words) for _ in range(rng.randrange(1, 12))]
        b = a[: rng.randrange(len(a) + 1)] + [rng.choice("xyz") if rng.random() < 0.8 else rng.choice(words) for _ in range(rng.randrange(1, 10))]
        early = line_dedup.parted_early(" ".join(a), " ".join(b))
        seen.add(early)
        assert not early or line_dedup.rough_edits(" ".join(a), " ".join(b), 10**6) == 10**6 + 1
    assert len(seen) == 2


def test_whole_buckets():
    bucket = np.repeat(np.arange(60), [1, 2, 3, 300, 5, 1] * 10)
    table = pa.table({"bucket": bucket, "row": np.arange(len(bucket))})
    for size in (1, line_dedup.ROW_BYTES * 50, 1 << 40):
        got = list(line_dedup.whole_buckets(iter(table.to_batches(max_chunksize=7)), size))
        assert pa.concat_tables(got).column("row").to_pylist() == list(range(len(bucket)))
        each = [set(t.column("bucket").to_pylist()) for t in got]
        assert sum(map(len, each)) == 60 and len(got) == 1 or size < 1 << 40 and len(got) > 10
    assert not list(line_dedup.whole_buckets(iter([]), 1))


def test_keys_travel_as_bytes(spark):
    """The bytes are those of the blocks' keys, by line; lines without blocks and null keys have none."""
    texts = ["one two three four five six\n\nshort", "seven eight nine ten eleven twelve thirteen fourteen"]
    rows = line_dedup.occurrences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id", "line").collect()
    wanted = [sorted(x) for t in texts for x in keys_of([t])]
    assert [sorted(np.frombuffer(r.keys, np.uint64).tolist()) for r in rows] == wanted and wanted[0] and not wanted[1]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([4, 5, 6]), pa.array([bytes(rows[0].keys), None, b""], pa.binary())], ["node", "size", "keys"])
    (out,) = line_dedup.listed(iter([batch]))
    assert out.column(2).to_pylist() == [np.frombuffer(rows[0].keys, np.int64).tolist(), [], []]


@pytest.mark.parametrize("bucket", [8, 4096])
def test_groups_of_lines(spark, bucket):
    """Against all pairs by edit similarity: no wrong link, and nine in ten of the groups' links at least; with copies of
    one to three changed words in lines of 5 to 60 words, and a large group that shares most blocks."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    lines = []
    for n in [5, 6, 7, 8, 9, 12, 15, 19, 20, 24, 30, 39, 40, 50, 60] * 3:
        base = [word() for _ in range(n)]
        lines.append(" ".join(base))
        for _ in range(2):
            other = list(base)
            for _ in range(max(1, n // 15)):
                kind, at = rng.random(), rng.randrange(len(other))
                if kind < 0.7:
                    other[at] = word()
                elif kind < 0.85:
                    other.insert(at, word())
                else:
                    del other[at]
            lines.append(" ".join(other))
    base = [word() for _ in range(30)]
    lines += [" ".join(base[:k] + [word()] + base[k + 1 :]) for k in range(30)]
    df = spark.createDataFrame([(i, line, "en", "s") for i, line in enumerate(lines)], SCHEMA)
    real = df.select("doc_id", "text")
    found = line_dedup.settle(line_dedup.occurrences(real))
    node = {r.node: r.doc_id for r in found.collect()}
    links = [(node[r.a], node[r.b]) for r in line_dedup.verified_links(real, found, bucket=bucket).collect()]
    wanted = plain_groups(lines)
    assert all(wanted[a] == wanted[b] for a, b in links)
    root = list(range(len(lines)))
    for a, b in links:
        a, b = sorted((root[a], root[b]))
        root = [a if r == b else r for r in root]
    joined = lambda groups: sum(g != i for i, g in enumerate(groups))
    assert joined(root) >= 0.9 * joined(wanted)
    if bucket == 4096:
        marks = line_dedup.mark_lines(df).collect()
        assert {r.doc_id for r in marks if r.kept} == {i for i, g in enumerate(root) if g == i}


def test_edits(spark):
    rng = random.Random(11)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for _ in range(400):
        a, b = ("".join(rng.choice("abü") for _ in range(rng.randint(0, 30))) for _ in range(2))
        d = plain(a, b)
        assert line_dedup.edits(a, b, 100) == d
        for most in range(0, 30, 5):
            assert (line_dedup.edits(a, b, most) <= most) == (d <= most)
        x, y = ("".join(rng.choice("ab   ") for _ in range(rng.randint(0, 40))) for _ in range(2))
        x, y = " ".join(x.split()), " ".join(y.split())
        assert min(plain(x, y), 21) <= line_dedup.rough_edits(x, y, 20)
    assert line_dedup.edits("x" * 30000, "x" * 15000 + "y" + "x" * 14999, 10) == 1


def test_packed_keys_are_all_keys():
    """Blocks and what goes row by row hold each key once, whatever counts as large; empty and null lists hold none."""
    rng = np.random.default_rng(5)
    keys = [rng.integers(-(2**63), 2**63 - 1, rng.integers(0, 9)).tolist() + [7] for _ in range(3000)] + [[], None]
    node, size = rng.integers(0, 2**62, len(keys)), rng.integers(1, 90, len(keys))
    batch = pa.RecordBatch.from_arrays([pa.array(node), pa.array(size, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["node", "size", "keys"])
    wanted = sorted((k, n, s) for n, s, own in zip(node.tolist(), size.tolist(), keys) for k in own or ())
    for large in ([], [7], [keys[0][0], 7]):
        held = np.zeros(1 << 18, np.int64)
        for k in large:
            slot = k & ((1 << 24) - 1)
            held[slot >> 6] |= np.int64(1) << np.int64(slot & 63)
        blocks = list(line_dedup.key_blocks(iter([batch.slice(0, 1000), batch.slice(1000)]), 5, held))
        assert len({p for b in blocks for p in b.column(0).to_pylist()}) == 5
        rows = [r for b in line_dedup.opened(iter(blocks)) for r in zip(*(c.to_pylist() for c in b.columns))]
        rest = [r for b in line_dedup.filtered_keys(iter([batch]), held) for r in zip(*(b.column(c).to_pylist() for c in ("bucket", "node", "size")))]
        assert sorted(rows + rest) == wanted
        assert {k for k, _, _ in rest} >= set(large) and not {k for k, _, _ in rows} & set(large)
    assert not list(line_dedup.key_blocks(iter([batch.slice(len(keys) - 2)]), 5, held))


def test_only_repeated_or_linked_lines_are_grouped(spark, monkeypatch):
    """A line that stands once and has no like goes through no grouping, and is told all the same."""
    kept = {}
    monkeypatch.setattr(line_dedup, "stored", lambda df, name: kept.setdefault(name, line_dedup.settle(df)))
    once = [f"line {chr(97 + i) * 5} of its own {chr(98 + i) * 7} kind" for i in range(20)]
    near = "a long line that stands here with a few words more than others have in it"
    rows = [(1, "\n".join(once)), (2, "twice it is\n" + near), (3, near.replace("others", "brothers") + "\ntwice it is")]
    got = {(r.doc_id, r.line): r.kept for r in line_dedup.mark_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, i): True for i in range(20)} | {(2, 0): True, (2, 1): True, (3, 0): False, (3, 1): False}
    assert {(r.doc_id, r.line) for r in kept["grouped"].collect()} == {(2, 0), (2, 1), (3, 0), (3, 1)}
