"""Repeated word windows across documents, counted exactly in super-k-mer buckets.

A window is ``WINDOW`` consecutive words of one document. Its minimiser is the least hash among its three-word runs.
Consecutive windows with one minimiser travel as one packed string (a super-k-mer), in a compressed block for each
bucket and slice of input, so that a word is sent about three times and not thirteen. In its bucket the windows are
sorted by hash and owner, and equal hashes are compared word by word. Windows that a smaller doc_id of the same slice
has too are settled before the shuffle, so that a passage that a third of all documents share is sent once a slice; all
places at which its least owner there has it are sent, as a smaller doc_id of another slice may remove each of them.
Minimisers above a share ``HOT_SHARE`` of a sample of the rows (fewer than 1 / HOT_SHARE values; they change only where
windows meet, never which) hand their windows to buckets by the hash of the whole window instead.

A word is removed if a window covers it that also starts in a document with a smaller doc_id; windows are those of the
input. Nulls: a null text has no words; rows without a doc_id remove nothing and lose nothing. Rows that
repeat a doc_id with another text lose what their own windows say, and remove nothing from each other. Texts below WINDOW words stay. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.llm.common import SLICE_BYTES, owned, pieces, repeated_ids, settle

WINDOW = 13
MINIMISER = 3
#: Buckets for each shuffle partition at least, and windows in a bucket at most, by the sample's count.
BUCKETS_EACH = 8
BUCKET_WINDOWS = 200_000
HOT_SHARE = 1 / 2048
HOT_SAMPLE = 0.02

_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MULT
    return x ^ (x >> np.uint64(29))


class Words:
    """The words of some texts as numbers: equal numbers, equal words."""

    def __init__(self, lines: list[list[bytes]]):
        names: dict[bytes, int] = {}
        every = [w for line in lines for w in line]
        self.ids = np.fromiter((names.setdefault(w, len(names)) for w in every), np.int64, len(every))
        own = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
        self.hashes = own[self.ids] if len(names) else np.zeros(0, np.uint64)
        self.line = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
        self.first = np.cumsum([0] + [len(x) for x in lines])

    def windows(self, width: int) -> np.ndarray:
        """Places at which a window starts."""
        n = len(self.ids) - width + 1
        return np.flatnonzero(self.line[:n] == self.line[width - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def window_hashes(self, width: int) -> np.ndarray:
        n = max(0, len(self.ids) - width + 1)
        out = np.zeros(n, np.uint64)
        for j in range(width):
            out = out * _MULT + self.hashes[j : j + n]
        return _mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[: len(x) - step], x[step:]) if len(x) > step else x[:0]
        step *= 2
    rest = width - step
    return (np.minimum(x[: len(x) - rest], x[rest:]) if len(x) > rest else x[:0]) if rest else x


def minimisers(words: Words, width: int) -> np.ndarray:
    return sliding_min(words.window_hashes(MINIMISER), width - MINIMISER + 1)


def owners(words: Words, places: np.ndarray, hashes: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window: the least owner of an equal window, and whether it is the first of its equals in that order.

    Equal hashes are put next to each other and compared word by word; should different windows share a hash, that
    run is sorted again by its words."""
    order = np.lexsort((places, owner, hashes))
    spot, sorted_hash = places[order], hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_hash[1:] != sorted_hash[:-1]
    twin = np.flatnonzero(~new)
    differ = np.zeros(len(twin), bool)
    for j in range(width):
        differ |= words.ids[spot[twin] + j] != words.ids[spot[twin - 1] + j]
    if differ.any():
        cuts = np.concatenate((np.flatnonzero(new), [len(order)]))
        for run in np.unique(np.searchsorted(cuts, twin[differ], side="right") - 1):
            lo, hi = cuts[run], cuts[run + 1]
            part = sorted(order[lo:hi].tolist(), key=lambda i: (words.ids[places[i] : places[i] + width].tolist(), owner[i], places[i]))
            order[lo:hi] = part
            text = [words.ids[places[i] : places[i] + width].tolist() for i in part]
            new[lo + 1 : hi] = [a != b for a, b in zip(text[1:], text[:-1])]
    group = np.cumsum(new) - 1
    least, first = np.empty(len(order), owner.dtype), np.zeros(len(order), bool)
    least[order] = owner[order][np.flatnonzero(new)][group] if len(order) else owner
    first[order] = new
    return least, first


def _runs(flag: np.ndarray, places: np.ndarray, key: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of flagged windows at consecutive places with one key."""
    at = np.flatnonzero(flag)
    if not len(at):
        return at, at
    cut = np.ones(len(at), bool)
    cut[1:] = np.diff(places[at]) != 1
    if key is not None:
        cut[1:] |= key[at][1:] != key[at][:-1]
    start = np.flatnonzero(cut)
    return at[start], at[np.concatenate((start[1:], [len(at)])) - 1]


_SHIPPED = "bucket int, n int, block binary"


def _block(doc: np.ndarray, own: np.ndarray, start: np.ndarray, length: np.ndarray, text: bytes | None, press: zstandard.ZstdCompressor) -> bytes:
    return press.compress(doc.astype(np.int64).tobytes() + own.astype(np.int32).tobytes() + start.astype(np.int32).tobytes() + length.astype(np.int32).tobytes() + (text or b""))


def ship(batches: Iterator[pa.RecordBatch], width: int, buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Super-k-mers by bucket; n is their number, or less than 0 for removed stretches that are settled already."""
    press = zstandard.ZstdCompressor(level=3)
    turn = 0
    for batch in pieces(batches, "text", SLICE_BYTES // 2):
        doc_ids, owns = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        lines = [t.encode("utf-8").split() for t in batch.column(1).to_pylist()]
        words = Words(lines)
        places = words.windows(width)
        if not len(places):
            continue
        line = words.line[places]
        owner = doc_ids[line]
        whole = words.window_hashes(width)[places]
        least, _ = owners(words, places, whole, owner, width)
        out: list[tuple[int, int, bytes]] = []
        a, b = _runs(owner > least, places)
        if len(a):
            turn += 1
            out.append(((turn * 7919 + int(doc_ids[0])) % buckets, -len(a), _block(owner[a], owns[line[a]], places[a] - words.first[line[a]], places[b] - places[a] + width, None, press)))
        key = minimisers(words, width)[places]
        if len(hot):
            key = np.where(np.isin(key, hot), whole, key)
        a, b = _runs(owner == least, places, key)
        bucket = (key[a] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        a, b, bucket = a[order], b[order], bucket[order]
        cuts = np.concatenate((np.flatnonzero(np.concatenate(([True], np.diff(bucket) != 0))), [len(a)]))
        flat = [w for x in lines for w in x]
        lo, hi = places[a], places[b] + width
        packed = [b" ".join(flat[i:j]) for i, j in zip(lo.tolist(), hi.tolist())]
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            out.append((int(bucket[i]), j - i, _block(owner[a[i:j]], owns[line[a[i:j]]], lo[i:j] - words.first[line[a[i:j]]], hi[i:j] - lo[i:j], b"\n".join(packed[i:j]), press)))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], ["bucket", "n", "block"])


def _stretches(doc: np.ndarray, own: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), *(pa.array(x, pa.int32()) for x in (own, start, stop))], ["doc_id", "own", "start", "stop"])


def sort_buckets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Removed stretches (doc_id, own, start, stop) of words; rows come sorted by bucket."""
    unpress = zstandard.ZstdDecompressor()

    def close(blocks: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        docs, owns, starts, lines = [], [], [], []
        for n, block in blocks:
            raw, k = unpress.decompress(block), abs(n)
            doc, (own, start, length) = np.frombuffer(raw, np.int64, k), (np.frombuffer(raw, np.int32, k, m * k) for m in (8, 12, 16))
            if n < 0:
                yield _stretches(doc, own, start, start + length)
                continue
            docs.append(doc)
            owns.append(own)
            starts.append(start)
            lines += [x.split(b" ") for x in raw[20 * k :].split(b"\n")]
        if not docs:
            return
        doc, own, start = np.concatenate(docs), np.concatenate(owns), np.concatenate(starts)
        words = Words(lines)
        places = words.windows(width)
        line = words.line[places]
        owner = doc[line]
        least, _ = owners(words, places, words.window_hashes(width)[places], owner, width)
        a, b = _runs(owner > least, places)
        if len(a):
            at = start[line[a]] + places[a] - words.first[line[a]]
            yield _stretches(owner[a], own[line[a]], at, at + places[b] - places[a] + width)

    held, blocks = None, []
    for batch in batches:
        for bucket, n, block in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != held and blocks:
                yield from close(blocks)
                blocks = []
            held = bucket
            blocks.append((n, block))
    yield from close(blocks)


def count_minimisers(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", SLICE_BYTES // 2):
        words = Words([t.encode("utf-8").split() for t in batch.column(1).to_pylist()])
        places = words.windows(width)
        if len(places):
            key = minimisers(words, width)[places]
            # once for each document, as equal windows of a slice travel once
            seen = np.unique(np.stack((words.line[places].astype(np.uint64), key)), axis=1)[1]
            value, count = np.unique(seen, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(count, pa.int64())], ["key", "n"])


def hot_minimisers(docs: DataFrame, width: int, share: float = HOT_SHARE, sample: float = HOT_SAMPLE) -> tuple[np.ndarray, int]:
    """Minimisers that hold more than ``share`` of the documents' minimisers in a sample, fewer than 1 / share; and about how
    many windows there are (a minimiser serves five on average)."""
    found = docs.sample(fraction=sample, seed=7).mapInArrow(lambda b: count_minimisers(b, width), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = settle(found)
    total = found.agg(F.sum("n")).first()[0] or 0
    rows = found.where(F.col("n") > max(8, total * share)).select("key").collect()
    return np.array([r.key for r in rows], np.int64).view(np.uint64), int(5 * total / sample)


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        made = []
        for text, stretches in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words = (text or "").encode("utf-8").split()
            keep = bytearray(b"\x01") * len(words)
            for s in stretches or ():
                keep[s["start"] : s["stop"]] = bytes(s["stop"] - s["start"])
            left = [w for w, k in zip(words, keep) if k] if stretches else words
            made.append((len(words), len(words) - len(left), b" ".join(left).decode("utf-8")))
        cols = list(zip(*made))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_text)`` for every row; kept words are joined by one space."""
    if width < MINIMISER:
        raise ValueError(f"a window has at least {MINIMISER} words")
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = owned(texts, repeated_ids(texts))
    real = texts.where("doc_id is not null and text is not null")
    hot, windows = hot_minimisers(real, width)
    # by the size of the input: neither a bucket nor a partition grows with it
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), windows // (BUCKETS_EACH * BUCKET_WINDOWS))
    buckets = BUCKETS_EACH * parts
    shipped = real.mapInArrow(lambda b: ship(b, width, buckets, hot), _SHIPPED)
    stretches = shipped.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: sort_buckets(b, width), "doc_id long, own int, start int, stop int")
    # as many stretches as a document has words at most
    of_doc = stretches.groupBy("doc_id", "own").agg(F.collect_list(F.struct("start", "stop")).alias("stretches"))
    return texts.join(of_doc, ["doc_id", "own"], "left").select("doc_id", "text", "stretches").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")
