"""What a task of training and of line dedup holds and does at most."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from lodeseam.llm import line_dedup, toxicity


def word(rng, least=6, most=12):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(least, most)))


def test_training_holds_a_bound_number_of_features():
    rng = random.Random(4)
    texts = [" ".join(word(rng) for _ in range(1000)) for _ in range(60)]
    kinds = [k % 4 for k in range(len(texts))]
    reader = toxicity.Reader(toxicity.Channel(np.ones((toxicity.SIZE,) * 3)))
    wanted = [Counter() for _ in toxicity.KINDS]
    for text, kind in zip(texts, kinds):
        wanted[kind].update(toxicity.document_features(reader, text))
    got, most = [Counter() for _ in toxicity.KINDS], 0
    for batch in toxicity.count_features(iter([pa.record_batch({"text": texts, "kind": kinds})]), reader):
        most = max(most, batch.num_rows)
        for feature, *n in zip(*(c.to_pylist() for c in batch.columns)):
            for counter, k in zip(got, n):
                counter[feature] += k
    assert [dict(+c) for c in got] == [dict(c) for c in wanted]
    # one text's beyond the bound, of more than twice as many
    assert most <= toxicity.HELD_FEATURES + 6000 < len(set().union(*wanted)) / 1.5


def test_a_worker_keeps_one_table_of_powers():
    for n in (10, 100_000, 300_000, 900_000):
        line_dedup.Lines(["word " * (n // 5)])
    assert line_dedup._powers.cache_info().currsize == 1


def plain_print(words):
    pairs = np.unique(words[:-1] * line_dedup._MULT + words[1:])
    bits = np.unpackbits(line_dedup.mix(line_dedup.mix(pairs)).view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(pairs)).view(np.int64)[0]


def test_whole_prints_count_each_pair_of_a_line_once():
    rng = random.Random(5)
    some = [word(rng) for _ in range(40)]
    text = "\n".join(" ".join(rng.choice(some) for _ in range(n)) for n in (4, 5, 17, 200, 256, 257, 258, 300, 2000, 60))
    lines = line_dedup.Lines([text, "some " * 50])
    rows = np.array([3, 0, 8, 9, 10, 5, 6, 7])
    wanted = [plain_print(lines.words[lines.first[k] : lines.first[k] + lines.n[k]]) for k in rows]
    assert line_dedup.whole_prints(lines, rows).tolist() == wanted


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edits_of_unlike_lines_end_early(monkeypatch):
    rng = random.Random(6)
    calls, beyond = [], line_dedup.beyond
    monkeypatch.setattr(line_dedup, "beyond", lambda *a: calls.append(1) or beyond(*a))
    a, b = (" ".join(word(rng) for _ in range(400)) for _ in range(2))
    assert line_dedup.edits(a, b, len(a) // 5) == len(a) // 5 + 1
    # a column in 32 is looked at; no more than half of the columns are made
    assert len(calls) <= len(b) // 64
    for k in range(150):
        a = " ".join(word(rng) for _ in range(rng.randint(1, 20)))
        b = "".join(rng.choice(("", c, c, c, c, c, c + "x", "y")) for c in a) if k % 3 else " ".join(word(rng) for _ in range(20))
        wanted = plain_edits(a, b)
        for most in (0, 3, len(a) // 5, len(a)):
            assert min(line_dedup.edits(a, b, most), most + 1) == min(wanted, most + 1)
