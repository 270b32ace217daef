"""Toxicity of texts after noisy-channel deobfuscation.

A writer's intended word passes a channel that swaps letters for look-alikes, repeats letters and spaces them out. For
every word that looks disturbed a lattice of intended characters is built (look-alikes, kept or dropped repeats, gaps
kept as word ends or dropped) and decoded by Viterbi under a character trigram model counted over all documents of the
input. The score is taken on the restored words.

The words' evidence is learned from labelled rows only: for each word beginning of three letters or more and each whole
word, in how many toxic and in how many other documents it stands (at most ``TRAIN_DOCS`` labelled documents, chosen by
a hash of doc_id). A feature counts if the lower bound of its toxic share reaches ``LEAST_SHARE``. A text's evidence is
the sum over its words of -log(1 - share), each by its strongest feature; a logistic curve turns it into the score. The
curve is fitted on half of the labelled documents with features from the other half, as features look stronger on the
documents they were chosen from; texts without evidence score the rate among such texts.

Nulls: a null text is empty; a null label is no label; rows without a doc_id are scored and never learned from. Without
usable labels every score is 0. Repeated rows are scored alike. Empty input gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseam.llm.common import freed, pieces, short_batches

TRAIN_DOCS = 20_000
#: Features that a task counts before it hands them on, and rows and bytes of texts that it is handed at a time in training.
HELD_FEATURES, BATCH_ROWS, BATCH_BYTES = 100_000, 1000, 4 << 20
#: Evidence: fewest documents, least lower bound of the toxic share.
LEAST_DOCS = 4
LEAST_SHARE = 0.6
PREFIXES = range(3, 8)
#: Kinds of labelled documents: not toxic or toxic, of the first or the second half.
KINDS = ("clean_a", "toxic_a", "clean_b", "toxic_b")

# The language model's characters: a word end, the letters, and one class for the rest.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)]))
END, OTHER = 0, len(LETTERS) + 1
SIZE = OTHER + 1
CLASS = {c: i + 1 for i, c in enumerate(LETTERS)}

# What a sign may stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
}
SWAP_COST, DROP_COST, DOUBLE_COST, KEEP_SIGN_COST, GAP_COST = 0.5, 0.7, 4.0, 12.0, 1.0
BARE = re.compile(r"^[^\w@$!|+(<€£¡*]+|[^\w@$]+$")
SPACED = re.compile(r"(?<!\S)\S(?:[ ]\S){2,}(?!\S)")
SPLIT = re.compile(r"[-._*~]")
_TABLE = np.full(0x110000 >> 4, OTHER, np.uint8)  # classes of characters below 0x11000; all others are OTHER
for _c, _i in CLASS.items():
    _TABLE[ord(_c)] = _i
    _TABLE[ord(_c.upper()) if len(_c.upper()) == 1 else ord(_c)] = _i
for _c in " \t\n\r\x0b\x0c":
    _TABLE[ord(_c)] = END


def trigram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of character triples of the task's texts; at most SIZE**3 rows."""
    total = np.zeros(SIZE**3, np.int64)
    for batch in pieces(batches, "text", 2 << 20):
        text = "\n\n" + "\n\n".join(t for t in batch.column(0).to_pylist()) + "\n\n"
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        x = _TABLE[np.minimum(code, len(_TABLE) - 1)].astype(np.int64)
        total += np.bincount((x[:-2] * SIZE + x[1:-1]) * SIZE + x[2:], minlength=SIZE**3)
    at = np.flatnonzero(total)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["triple", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """Costs (-log chance) of a character after two others, from all texts. The triples are bounded by the alphabet."""
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    counted = texts.mapInArrow(freed(trigram_counts), "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n"))
    with short_batches(docs.sparkSession, BATCH_ROWS, BATCH_BYTES):
        rows = counted.toPandas()
    counts = np.zeros(SIZE**3)
    counts[rows["triple"].to_numpy(np.int64)] = rows["n"]
    counts = counts.reshape(SIZE, SIZE, SIZE)
    one = counts.sum(axis=(0, 1)) + 1.0
    one /= one.sum()
    two = counts.sum(axis=0)
    two = (two + 20 * one) / (two.sum(axis=1, keepdims=True) + 20)
    three = (counts + 5 * two) / (counts.sum(axis=2, keepdims=True) + 5)
    return -np.log(three)


class Channel:
    """Restores disturbed words."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.astype(np.float32).tolist()

    def lattice(self, written: str) -> list[list[tuple[str, float]]]:
        """What each written character may mean, with costs; "" drops it, " " ends a word."""
        out = []
        for i, c in enumerate(written):
            again = i > 0 and c == written[i - 1]
            if c in CLASS:
                arcs = [(c, 0.0)]
            elif c == " ":
                arcs = [("", 0.0), (" ", GAP_COST)]
            else:
                arcs = [(x, SWAP_COST) for x in LOOKS.get(c, "")] + [(c, KEEP_SIGN_COST)]
                if not c.isalnum():
                    arcs.append(("", DROP_COST))
            if again and c != " ":
                # two of a letter are common, three are not
                three = written[i - 2 : i - 1] == c or written[i + 1 : i + 2] == c
                arcs = [(x, k + DROP_COST * three) for x, k in arcs if x] + [("", 0.0 if three else DOUBLE_COST)]
            out.append(arcs)
        return out

    def restore(self, written: str) -> str:
        """The likeliest intended text: a shortest path; a state is the last two characters meant."""
        costs = self.costs
        best: dict[tuple[int, int], tuple[float, tuple]] = {(END, END): (0.0, ())}
        for arcs in self.lattice(written):
            step: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (cost, path) in best.items():
                for meant, price in arcs:
                    if meant == "":
                        state, total, way = (a, b), cost + price, path
                    else:
                        c = CLASS.get(meant, END if meant == " " else OTHER)
                        state, total, way = (b, c), cost + price + costs[a][b][c], (path, meant)
                        if meant == " ":
                            state = (END, END)
                    if state not in step or total < step[state][0]:
                        step[state] = (total, way)
            best = step
        path = min((cost + costs[a][b][END], way) for (a, b), (cost, way) in best.items())[1]
        out = []
        while path:
            path, meant = path
            out.append(meant)
        return "".join(reversed(out))


def bare(token: str) -> str:
    return BARE.sub("", token)


def disturbed(word: str) -> bool:
    """A word with signs among its letters, or with a letter three times in a row or two at its end."""
    if word.isalpha():
        return any(a == b == c for a, b, c in zip(word, word[1:], word[2:])) or (len(word) > 2 and word[-1] == word[-2])
    return any(c.isalpha() for c in word) and all(c.isalpha() or c in LOOKS or SPLIT.match(c) for c in word)


class Reader:
    """The restored words of texts; what a word becomes is kept, up to a bound."""

    KEPT = 200_000

    def __init__(self, channel: Channel, features: dict[str, float] | None = None):
        self.channel, self.features = channel, features
        self.kept: dict[str, object] = {}

    def words(self, token: str) -> list[str]:
        """What a written token may say: itself, and restored if it is disturbed."""
        word = bare(token)
        out = [word] if word else []
        if word and disturbed(word):
            out += [w for w in self.channel.restore(word).split() if w != word]
        elif word and not word.isalpha():
            out += [w for w in SPLIT.split(word) if len(w) > 2]
        return out

    def spaced(self, text: str) -> list[str]:
        """Words of letters that stand apart from each other."""
        return [w for m in SPACED.finditer(text) for w in self.channel.restore(m.group()).split() if len(w) > 2]

    def evidence(self, token: str) -> float:
        """The strongest feature of a token's words, 0 if there is none."""
        features = self.features
        return max((features.get(f, 0.0) for w in self.words(token) for f in word_features(w)), default=0.0)

    def found(self, text: str) -> dict[str, float]:
        """Tokens with evidence, each once."""
        kept, out = self.kept, {}
        low = text.lower()
        for token in set(low.split()):
            value = kept.get(token)
            if value is None:
                value = self.evidence(token)
                if len(kept) >= self.KEPT:
                    kept.clear()
                if len(token) <= 64:
                    kept[token] = value
            if value:
                out[token] = value
        for word in self.spaced(low):
            value = max((self.features.get(f, 0.0) for f in word_features(word)), default=0.0)
            if value:
                out[word] = value
        return out


def word_features(word: str) -> list[str]:
    return ["^" + word[:n] for n in PREFIXES if n < len(word)] + ["^" + word + "$"]


def document_features(reader: Reader, text: str) -> set[str]:
    low = text.lower()
    words = {w for t in set(low.split()) for w in reader.words(t)} | set(reader.spaced(low))
    return {f for w in words if len(w) > 1 for f in word_features(w)}


def count_features(batches: Iterator[pa.RecordBatch], reader: Reader) -> Iterator[pa.RecordBatch]:
    """In how many texts ``(text, kind)`` of each kind a feature stands; those of about HELD_FEATURES are held at a time, and a
    feature may come again."""
    counts: dict[str, list[int]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array(n, pa.int64()) for n in zip(*counts.values()))], ["feature", *KINDS])
            counts.clear()

    for batch in pieces(batches, "text"):
        for text, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for feature in document_features(reader, text):
                if (n := counts.get(feature)) is None:
                    n = counts[feature] = [0] * len(KINDS)
                n[kind] += 1
            if len(counts) > HELD_FEATURES:
                yield from flush()
    yield from flush()


class Model:
    """The language model's costs, the features' evidence, the curve, the rate among texts without evidence."""

    def __init__(self, costs: np.ndarray, features: dict[str, float], curve: tuple[float, float] = (0.0, 1.0), rate: float = 0.0):
        self.costs, self.features, self.curve, self.rate = costs, features, curve, rate

    def reader(self) -> Reader:
        return Reader(Channel(self.costs), self.features)

    def score(self, found: dict[str, float]) -> float:
        if not found:
            return self.rate
        return 1.0 / (1.0 + math.exp(-self.curve[0] - self.curve[1] * evidence_sum(found)))


def evidence_sum(found: dict[str, float]) -> float:
    """At most 10, where every curve is flat."""
    return min(10.0, -sum(math.log1p(-min(v, 0.999)) for v in found.values()))


def fit_curve(levels: np.ndarray, toxic: np.ndarray, seen: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic curve by Newton's method, with a weak pull towards (-2, 1)."""
    start = np.array([-2.0, 1.0])
    w, x = start.copy(), np.stack([np.ones_like(levels), levels])
    for _ in range(50):
        p = 1 / (1 + np.exp(-w @ x))
        slope = x @ (toxic - seen * p) - 0.1 * (w - start)
        w = w + np.linalg.solve((x * (seen * p * (1 - p))) @ x.T + 0.1 * np.eye(2), slope)
    return float(w[0]), float(max(0.0, w[1]))


def lower_bound(toxic: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Lower end of the 90 % Wilson interval of a share."""
    z = 1.2816
    share = toxic / seen
    middle = share + z * z / (2 * seen)
    return (middle - z * np.sqrt(share * (1 - share) / seen + z * z / (4 * seen * seen))) / (1 + z * z / seen)


def train(docs: DataFrame, labels: DataFrame, docs_bound: int = TRAIN_DOCS) -> Model:
    """Learn from ``labels(doc_id, toxic)``, at most ``docs_bound`` documents. The features that reach the driver stand in
    LEAST_DOCS of these documents at least, which bounds them by the documents' length."""
    costs = language_model(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    given = given.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    scale = 1 << 30
    chosen = given.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < int(min(1, docs_bound / max(1, given.count())) * scale)).limit(docs_bound)
    rows = texts.join(chosen, "doc_id").select("text", (F.col("toxic") + 2 * F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int")).alias("kind"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return count_features(batches, Reader(Channel(costs)))

    counted = rows.mapInArrow(freed(count), "feature string, clean_a long, toxic_a long, clean_b long, toxic_b long").groupBy("feature").agg(*[F.sum(n).alias(n) for n in KINDS])
    toxic, clean = F.col("toxic_a") + F.col("toxic_b"), F.col("clean_a") + F.col("clean_b")
    with short_batches(docs.sparkSession, BATCH_ROWS, BATCH_BYTES):
        got = counted.where((toxic >= LEAST_DOCS) & (toxic > clean)).toPandas().sort_values("feature", ignore_index=True)

    def features(halves: str, least: int) -> dict[str, float]:
        toxic, clean = (sum(got[f"{k}_{h}"].to_numpy(float) for h in halves) for k in ("toxic", "clean"))
        at = np.flatnonzero(toxic >= least)
        value = lower_bound(toxic[at], toxic[at] + clean[at])
        return {got["feature"].iloc[i]: float(v) for i, v in zip(at, value) if v >= LEAST_SHARE}

    half = Model(costs, features("a", max(2, LEAST_DOCS // 2)))

    def outcome(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, n = half.reader(), Counter()
        for batch in pieces(batches, "text"):
            for text, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n[round(20 * evidence_sum(reader.found(text))), kind % 2] += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in n]), pa.array([t for _, t in n]), pa.array(list(n.values()))], ["level", "toxic", "n"])

    # at most 201 levels
    rest = rows.where("kind >= 2").mapInArrow(freed(outcome), "level long, toxic long, n long").groupBy("level").agg(F.sum(F.col("n") * F.col("toxic")).alias("toxic"), F.sum("n").alias("n"))
    with short_batches(docs.sparkSession, BATCH_ROWS, BATCH_BYTES):
        levels = rest.toPandas().sort_values("level")
    none = levels[levels["level"] == 0]
    some = levels[levels["level"] > 0]
    toxic, seen = (float(none[c].sum()) for c in ("toxic", "n"))
    curve = fit_curve(some["level"].to_numpy(float) / 20, some["toxic"].to_numpy(float), some["n"].to_numpy(float))
    return Model(costs, features("ab", LEAST_DOCS), curve, min(0.49, (toxic + 0.5) / (seen + 1.0)) if seen else 0.0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, evidence)`` for every row; evidence holds all tokens that have some, most evident first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.reader()
        for batch in pieces(batches, "text"):
            found = [reader.found(t or "") for t in batch.column(1).to_pylist()]
            tokens = [sorted(f, key=lambda w: (-f[w], w)) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(f) for f in found], pa.float64()), pa.array(tokens, pa.list_(pa.string()))], ["doc_id", "score", "evidence"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(freed(work), "doc_id long, score double, evidence array<string>")


def keep_clean(docs: DataFrame, model: Model, most: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``most``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.reader()
        for batch in pieces(batches, "text"):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([model.score(reader.found(t or "")) < most for t in texts], pa.bool_()))

    return docs.mapInArrow(freed(work), docs.schema)


def held_out() -> Column:
    """Rows that nothing may be learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
