"""Alignment of two tokenizers' tokens over the same bytes.

A document's bytes are a space and its text. Of all documents of a slice, laid end to end, the places where a token of A
ends are one packed bitset, those of B another; AND leaves the cuts that both share, which part the tokens into groups.
Ranks by popcount say which tokens of A and of B a group has; every token of A in a group is linked with every one of B.
Links are expanded for a bound number at a time and held as counts of distinct id pairs of each document.

A pair's count is the number of documents that hold it linked. A task adds its documents' pairs up before they move, so
what is shuffled are distinct pairs of a task; how many there can be is bound by the two vocabularies. The documents' own
pairs stay where they are, compressed, in the shared checkpoint folder. Counts go back to them as a broadcast of at most
``MOST_SENT`` pairs; if there are more, in several, by hash of A's id, so that the pairs of an id stay together: each
round reads the documents' pairs again and the rounds' sums are added up by document. Nothing is left out at any size.

Token bytes: A's are those of the rank file, the same vocabulary as the .json (a test compares the ids over all code
points), B's are its pieces, U+2581 read as a space and <0xHH> as that byte.

Null and empty texts, and those whose bytes of A or of B joined differ from the space and the text (U+2581 in the text,
for instance), have no tokens: zeros and an empty string. Special tokens' strings are plain text. Each row is a document,
also those that repeat a doc_id or have none. Empty input gives no rows; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.llm import packing
from lodeseam.llm.common import pieces, settle, short_batches

#: Pairs whose counts are broadcast at once: 16 bytes each and a flag.
MOST_SENT = 6_000_000
#: Links that are expanded at once.
MOST_LINKS = 1 << 21
#: Bytes of text that are encoded at once.
SLICE = 4 << 20
#: Pairs that a task gathers before it sums them up.
GATHERED = 1 << 22


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def bit_marks(ends: np.ndarray, size: int) -> np.ndarray:
    """A packed bitset of ``size`` places with those before ``ends`` set."""
    marks = np.zeros(-(-size // 64) * 64, np.uint8)
    marks[ends - 1] = 1
    return np.packbits(marks, bitorder="little").view(np.uint64)


class Ranks:
    """Rank over a packed bitset: how many of its places up to a place are set."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def __call__(self, ends: np.ndarray) -> np.ndarray:
        last = ends - 1
        kept = self.words[last >> 6] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - (last & 63).astype(np.uint64)))
        return self.before[last >> 6] + np.bitwise_count(kept).astype(np.int64)


def selected(words: np.ndarray) -> np.ndarray:
    """The ends whose places are set, in order."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")) + 1


def groups(ends_a: np.ndarray, ends_b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shared cuts, and how many tokens of A and of B end up to each."""
    words_a, words_b = bit_marks(ends_a, size), bit_marks(ends_b, size)
    cuts = selected(words_a & words_b)
    return cuts, Ranks(words_a)(cuts), Ranks(words_b)(cuts)


def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[k], starts[k] + 1, …`` for each k, ``counts[k]`` of them."""
    first = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - np.repeat(first - starts, counts)


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their times."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(times, first) if len(keys) else times


class Aligner:
    """Two tokenizers and the tables of their tokens' bytes."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = packing.load(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.n_a = max(packing.added_tokens(path_a).values(), default=0) + 1
        self.n_a, self.n_b = max(self.n_a, self.a.n_vocab), self.b.get_piece_size()
        self.bytes_a = [b""] * self.n_a
        for word, rank in self.a._mergeable_ranks.items():
            self.bytes_a[rank] = word
        self.bytes_b = []
        for i in range(self.n_b):
            piece = self.b.id_to_piece(i)
            byte = re.fullmatch(r"<0x([0-9A-Fa-f]{2})>", piece) if self.b.is_byte(i) else None
            self.bytes_b.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        #: What a group's tokens are written as: inside and at the end of A's, then of B's.
        self.written = [f"{i}{sign}".encode() for n, signs in ((self.n_a, ",|"), (self.n_b, ",;")) for sign in signs for i in range(n)]

    def encoded(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """Ids of A and of B; none where there is no text or the bytes differ."""
        of_b = self.b.encode([t or "" for t in texts], num_threads=1)
        out = []
        for text, b in zip(texts, of_b):
            whole = f" {text or ''}".encode()
            a = self.a.encode_ordinary(f" {text}") if text and b"".join(map(self.bytes_b.__getitem__, b)) == whole else []
            out.append((a, b) if a and b"".join(map(self.bytes_a.__getitem__, a)) == whole else ([], []))
        return out

    def documents(self, texts: list[str | None]) -> Iterator[tuple]:
        """For each text (n_a, n_b, n_groups, n_links, groups_sha256, pairs, times), pairs being A's id times B's size
        of vocabulary plus B's id, in order."""
        encoded = self.encoded(texts)
        count_a, count_b = (np.array([len(x[k]) for x in encoded], np.int64) for k in (0, 1))
        ids_a, ids_b = (np.fromiter(chain.from_iterable([x[k] for x in encoded]), np.int64, int(n.sum())) for k, n in ((0, count_a), (1, count_b)))
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        cuts, upto_a, upto_b = groups(ends_a, ends_b, int(ends_a[-1]) if len(ends_a) else 0)
        of_a, of_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
        start_a, start_b = upto_a - of_a, upto_b - of_b
        # tokens of A and of B in the order of their groups
        group_a, group_b = np.repeat(np.arange(len(cuts)), of_a), np.repeat(np.arange(len(cuts)), of_b)
        line = np.empty(len(ids_a) + len(ids_b), np.int64)
        line[np.arange(len(ids_a)) + start_b[group_a]] = ids_a
        line[np.arange(len(ids_b)) + upto_a[group_b]] = ids_b + 2 * self.n_a
        line[upto_a + start_b - 1] += self.n_a
        line[upto_a + upto_b - 1] += self.n_b
        # groups of each document, from its tokens
        last_a = np.cumsum(count_a)
        until = np.searchsorted(upto_a, last_a, side="right")
        n_groups = np.diff(until, prepend=0)
        links = np.concatenate([[0], np.cumsum(of_a * of_b)])
        pairs, times, edge = self.linked(ids_a, ids_b, of_b[group_a], start_b[group_a], np.repeat(np.arange(len(texts)), count_a), len(texts))
        starts = np.concatenate([[0], np.cumsum(count_a + count_b)])
        low = 0
        for k in range(len(texts)):
            high, size = int(until[k]), int(n_groups[k])
            written = b"".join(map(self.written.__getitem__, line[starts[k] : starts[k + 1]].tolist()))[:-1]
            digest = hashlib.sha256(written).hexdigest() if size else ""
            yield int(count_a[k]), int(count_b[k]), size, int(links[high] - links[low]), digest, pairs[edge[k] : edge[k + 1]], times[edge[k] : edge[k + 1]]
            low = high

    def linked(self, ids_a: np.ndarray, ids_b: np.ndarray, many: np.ndarray, first: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of each document with their numbers of links, and where each document's begin. Each token of A
        is linked to ``many`` of B from ``first``; tokens are taken together up to ``MOST_LINKS`` links."""
        upto, keys, times, at = np.cumsum(many), [], [], 0
        while at < len(ids_a):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + MOST_LINKS, side="right")))
            part = slice(at, stop)
            b = ids_b[runs(first[part], many[part])]
            key = np.repeat((doc[part] * self.n_a + ids_a[part]) * self.n_b, many[part]) + b
            key, n = np.unique(key, return_counts=True)
            keys.append(key)
            times.append(n)
            at = stop
        key, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, times))
        if len(keys) > 1:
            key, n = summed(key, n)
        size = self.n_a * self.n_b
        edge = np.searchsorted(key, np.arange(n_docs + 1) * size)
        return key % size, n, edge


def press(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """Ordered pairs as steps, and their times; numbers of four bytes where they fit."""
    steps = np.diff(pairs, prepend=0)
    wide = len(steps) and (steps.max() >= 1 << 32 or times.max() >= 1 << 32)
    kind = "<u8" if wide else "<u4"
    return bytes([8 if wide else 4]) + zstandard.ZstdCompressor(level=1).compress(steps.astype(kind).tobytes() + times.astype(kind).tobytes())


def unpress(held: bytes) -> tuple[np.ndarray, np.ndarray]:
    whole = np.frombuffer(zstandard.ZstdDecompressor().decompress(held[1:]), f"<u{held[0]}").astype(np.int64)
    half = len(whole) // 2
    return np.cumsum(whole[:half]), whole[half:]


DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, held binary, pairs array<long>, counts array<long>"
NAMES = [x.split()[0] for x in DOCUMENT.split(", ")]


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each document, with its pairs in ``held``, and rows of what a task's documents sum up to, whose ``held``
    is null."""

    def part(columns: dict[str, list], n: int) -> pa.RecordBatch:
        kinds = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), k) for c, k in zip(NAMES, kinds)], NAMES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        sums: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in pieces(batches, "text", SLICE):
            columns: dict[str, list] = {c: [] for c in NAMES[:7]}
            columns["doc_id"] = batch.column(0).to_pylist()
            seen = []
            for n_a, n_b, n_groups, n_links, digest, pairs, times in aligner.documents(batch.column(1).to_pylist()):
                for c, v in zip(NAMES[1:7], (n_a, n_b, n_groups, n_links, digest, press(pairs, times))):
                    columns[c].append(v)
                seen.append(pairs)
            yield part(columns, batch.num_rows)
            sums.append(np.unique(np.concatenate(seen), return_counts=True))
            if sum(len(k) for k, _ in sums) > GATHERED:
                sums = [summed(*(np.concatenate(x) for x in zip(*sums)))]
                if len(sums[0][0]) > GATHERED // 2:
                    yield part({"pairs": [sums[0][0]], "counts": [sums[0][1]]}, 1)
                    sums = []
        if sums:
            keys, counts = summed(*(np.concatenate(x) for x in zip(*sums)))
            for at in range(0, len(keys), 1 << 18):
                yield part({"pairs": [keys[at : at + (1 << 18)]], "counts": [counts[at : at + (1 << 18)]]}, 1)

    with short_batches(docs.sparkSession):
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return texts.mapInArrow(work, DOCUMENT)


def pair_counts(made: DataFrame) -> DataFrame:
    """``(pair, docs)``: in how many documents each id pair is linked."""
    each = made.where("held is null").select(F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
    return each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("docs"))


def scored(rows: DataFrame, counts: DataFrame, n_b: int, part: int, parts: int) -> DataFrame:
    """The rows, their pairs replaced by ``n_best`` and ``count_sum`` over the pairs whose id of A falls into one part."""
    a = F.col("pair") - F.pmod("pair", F.lit(n_b))
    table = counts.where(F.pmod(F.xxhash64(a), F.lit(parts)) == part).toPandas().sort_values("pair")
    pairs, docs = table["pair"].to_numpy(np.int64), table["docs"].to_numpy(np.int64)
    first = np.flatnonzero(np.diff(pairs // n_b, prepend=-1)) if len(pairs) else np.zeros(0, np.int64)
    most = np.repeat(np.maximum.reduceat(docs, first), np.diff(np.append(first, len(docs)))) if len(pairs) else docs
    sent = rows.sparkSession.sparkContext.broadcast((pairs, docs, docs == most))
    passed = [c for c in rows.columns if c != "held"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, docs, best = sent.value
        for batch in pieces(batches, "held", 2 << 20):
            n_best, total = [], []
            for held in batch.column(batch.num_columns - 1).to_pylist():
                pairs, times = unpress(held)
                at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
                here = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
                at, times = at[here], times[here]
                n_best.append(int(times[best[at]].sum()))
                total.append(int((docs[at] * times).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n_best, pa.int64()), pa.array(total, pa.int64())], [*passed, "n_best", "count_sum"])

    schema = ", ".join(f"{name} {kind}" for name, kind in rows.select(*passed).dtypes)
    return rows.select(*passed, "held").mapInArrow(work, f"{schema}, n_best long, count_sum long")


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, most_sent: int = MOST_SENT) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, a row for each document."""
    path_a, path_b = path_a or packing.vocabulary_path(), path_b or model_path()
    n_b = Aligner(path_a, path_b).n_b
    made = settle(aligned(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()))
    counts = settle(pair_counts(made))
    parts = max(1, -(-counts.count() // most_sent))
    rows = made.where("held is not null").drop("pairs", "counts")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if parts == 1:
        return scored(rows, counts, n_b, 0, 1).select(*names)
    sums = reduce(DataFrame.unionByName, [settle(scored(rows, counts, n_b, part, parts)) for part in range(parts)])
    of = [c for c in rows.columns if c != "held"]
    return sums.groupBy(*of).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")).select(*names)
