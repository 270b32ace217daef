"""Fuzzy line deduplication over the whole corpus.

Lines are normalised: lower case, digits to 0, other ASCII signs to spaces, single spaces. Lines without a word never
take part, all others do; equal normalised lines are one node. A node's words are cut into blocks of one width (two to 160 words, by
the line's length), the first half counted from its start and the second from its end, so that a word put in or left
out moves no block before or behind it. The fingerprint of a line is the row of the 64-bit SimHashes of its blocks, and
lines that share a block at one place meet. By the pigeonhole principle lines of b blocks meet wherever fewer than b
words were replaced, and with words put in or left out unless these touch the first and the last block alike. Lines at
the edge of a length class are cut to both widths. Lines of fewer than four words are cut by characters if they have
``LEAST_CHARS`` of them, and are only compared for equality if not.

Lines that meet, are of like length and lie at most ``FAR`` bits apart by the SimHash of the whole line (its pairs of
neighbouring words) are verified by edit similarity (1 - edits / longer length, ``LEAST_SIMILARITY`` at least) of the
normalised lines. FAR is measured: of the pairs of similarity 0.8 on sf0.01 99 in 100 lie within 19 bits, and of lines in
which a fifth of the words was changed 96 in 100 within 24; unrelated lines that share a block lie further apart 16 times
in 17. Of every connected group the occurrence with the smallest (doc_id, line number)
stays. Texts move only where they must: blocks travel as hashes, packed by the task that sorts them, lines that met the same lines in several blocks travel
once, and a Bloom filter of bound size tells which documents hold a line in question or may lose one.

Nulls: a null text has no lines; lines of rows without a doc_id stay and do not count. Rows that
repeat a doc_id with another text are documents of their own, told apart by a hash of the text; equal rows are one and keep
or lose the same lines. Extra columns may have any name; one called as the column of removed lines makes room for it.
Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator, Sequence
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseam.llm.common import bloom_words, components, filter_bits, freed, in_filter, local_forest, maybe_in, owned, packed, pieces, repeated_ids, settle, short_batches, stored
from lodeseam.llm.simhash_dedup import BUCKET, dealt, edge_batches, large_buckets, sampled

LEAST_SIMILARITY = 0.8
#: Lines that meet are verified if their whole SimHashes differ in at most so many of 64 bits.
FAR = 24
LEAST_UNITS = 4
LEAST_CHARS = 32
#: Widths of blocks, and the number of words from which each is used.
WIDTHS = ((2, LEAST_UNITS), (3, 8), (4, 20), (8, 40), (16, 80), (32, 160), (64, 320), (128, 640), (160, 1280))
#: How many of them are narrow: their blocks are told word by word, those of wider ones from running sums.
NARROW = 5
#: Rows that a task sorts at a time when it looks for lines that meet.
TASK_ROWS = 2_000_000
#: Bytes of text whose lines are told together; what is made of them stays in a core's cache.
SLICE = 1 << 18
#: Nodes that a task remembers, so as not to tell them again.
SEEN = 200_000
#: Keys that are packed into blocks together, and rows and bytes of blocks that a task is handed at a time.
BLOCK_KEYS, BLOCK_ROWS, BLOCK_BYTES = 200_000, 2000, 8 << 20
_TABLE = bytes(c if c >= 128 or c == 10 or chr(c).isalpha() else 48 if chr(c).isdigit() else 32 for c in range(256))
_LOW = np.uint64(0x0101010101010101)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MULT
    return x ^ (x >> np.uint64(29))


#: A random number for each byte.
_CODES = mix(mix(np.arange(1, 257, dtype=np.uint64)))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and of its inverse; read only. Workers live on, so one table is kept."""
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, _MULT))))
        down = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, np.uint64(pow(int(_MULT), -1, 1 << 64))))))
    return up, down


def run_hashes(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the runs values[start:stop]: polynomials modulo 2**64, taken as differences of running sums."""
    up, down = _powers(1 << max(19, len(values).bit_length()))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))


class Lines:
    """The normalised lines of some texts that have a word: their text, line number, node and words."""

    def __init__(self, texts: list[str]):
        whole = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
        data = b"\n".join(whole).translate(_TABLE)
        self.data = data
        code = np.frombuffer(data, np.uint8)
        newline = code == 10
        black = (code != 32) & ~newline
        edge = np.diff(np.concatenate(([False], black, [False])).view(np.int8))
        self.start, self.stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.words = run_hashes(_CODES[code], self.start, self.stop)
        ends = np.flatnonzero(newline)
        line_of = np.repeat(np.arange(len(ends) + 1), np.diff(np.searchsorted(self.start, ends), prepend=0, append=len(self.start)))
        new = np.ones(len(line_of), bool)
        new[1:] = line_of[1:] != line_of[:-1]
        self.first = np.flatnonzero(new)
        self.n = np.diff(np.concatenate((self.first, [len(line_of)])))
        self.node = (run_hashes(self.words, self.first, self.first + self.n) >> np.uint64(1)).view(np.int64)
        self.line, self.ends, self.bytes = line_of[self.first], ends, [len(x) for x in whole]

    @cached_property
    def text(self) -> np.ndarray:
        # a text of k lines has k - 1 line ends, and one more parts it from the next
        return np.searchsorted(np.cumsum(self.bytes) + np.arange(1, len(self.bytes) + 1), self.start[self.first], side="right")

    @cached_property
    def number(self) -> np.ndarray:
        before = np.concatenate(([0], np.cumsum(self.bytes) + np.arange(1, len(self.bytes) + 1)))[self.text]
        return self.line - np.searchsorted(self.ends, before)

    @cached_property
    def size(self) -> np.ndarray:
        """Characters of the normalised lines."""
        if self.data.isascii():
            return np.add.reduceat(self.stop - self.start, self.first) + self.n - 1 if len(self.first) else self.n
        code = np.frombuffer(self.data, np.uint8)
        letters = np.concatenate(([0], np.cumsum((code != 32) & (code != 10) & ((code & 0xC0) != 0x80))))
        return letters[self.stop[self.first + self.n - 1]] - letters[self.start[self.first]] + self.n - 1

    def normal(self, k: int) -> str:
        """The normalised text of a line."""
        span = self.data[self.start[self.first[k]] : self.stop[self.first[k] + self.n[k] - 1]]
        return b" ".join(span.split()).decode("utf-8", "replace")


def whole_prints(lines: Lines, rows: np.ndarray) -> np.ndarray:
    """SimHashes of some whole lines by their distinct pairs of neighbouring words, or of characters where blocks are cut
    by these."""
    pairs = lines.words[:-1] * _MULT + lines.words[1:]
    words = lines.n[rows] >= LEAST_UNITS
    order = np.concatenate((np.flatnonzero(words), np.flatnonzero(~words)))
    count = lines.n[rows[words]] - 1
    features = [pairs[np.repeat(lines.first[rows[words]], count) + _ramp(count)]]
    for k in rows[~words].tolist():
        letters = np.frombuffer(lines.normal(k).encode("utf-32-le"), np.uint32).astype(np.uint64)
        features.append(letters[:-1] * _MULT + letters[1:] if len(letters) > 1 else letters)
    line = np.repeat(order, np.concatenate((count, [len(x) for x in features[1:]])).astype(np.int64))
    hashes = np.concatenate(features)
    # a feature that a line has twice counts once; marks of equal features of a line are equal
    mark = mix(mix(hashes + line.astype(np.uint64) * _CODES[0]))
    by = np.argsort(mark)
    again = by[1:][(mark[by[1:]] == mark[by[:-1]]) & (line[by[1:]] == line[by[:-1]])]
    hashes, line = mix(mix(np.delete(hashes, again))), np.delete(line, again)
    n = np.bincount(line, minlength=len(rows))[order]
    stop, out = np.cumsum(n), np.zeros(len(n), np.int64)
    few = n <= 255
    # what is counted in bytes is put back into the order of unpackbits
    sums = bit_sums(hashes)
    counts = np.ascontiguousarray(sums[stop[few]] - sums[stop[few] - n[few]]).view(np.uint8).reshape(-1, 8, 8)
    out[order[few]] = np.packbits((counts.transpose(0, 2, 1)[:, :, ::-1] > (n[few] // 2)[:, None, None]).reshape(-1, 64), axis=1).view(np.int64).ravel()
    for k in np.flatnonzero(~few).tolist():
        bits = np.unpackbits(hashes[stop[k] - n[k] : stop[k]].view(np.uint8).reshape(-1, 8), axis=1)
        out[order[k]] = np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > n[k]).view(np.int64)[0]
    return out


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """Running sums: number k of a row holds how often bits k, 8 + k, ... were set, in a byte each. The sum over up to 255
    words is the difference of two rows, as what overflows cancels out."""
    out = np.zeros((8, len(hashes) + 1), np.uint64)
    for k in range(8):
        np.cumsum((hashes >> np.uint64(k)) & _LOW, out=out[k, 1:])
    return out.T


def simhash(sums: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of the ``width`` words from each start: a bit is set if it is in over half of their hashes."""
    counts = np.ascontiguousarray(sums[starts + width] - sums[starts]).view(np.uint8).reshape(-1, 64)
    return np.packbits(counts > width // 2, axis=1).view(np.uint64).ravel()


def majority(hashes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """As ``simhash``, in another order of bits: all bits are counted at once, number k of the planes holds the bits of
    weight 2**k of their counts. For small widths far less than running sums."""
    planes: list[np.ndarray] = []
    for t in range(width):
        carry = hashes[starts + t]
        for k, plane in enumerate(planes):
            planes[k], carry = plane ^ carry, plane & carry
        if t & (t + 1) == 0:
            planes.append(carry)
    more, equal = np.zeros(len(starts), np.uint64), np.full(len(starts), ~np.uint64(0))
    for k, plane in reversed(list(enumerate(planes))):
        if width // 2 >> k & 1:
            equal &= plane
        else:
            more |= equal & plane
            equal &= ~plane
    return more


def width_class(n: np.ndarray) -> np.ndarray:
    """The place in WIDTHS of lines of n words, -1 for those without blocks."""
    return np.searchsorted([least for _, least in WIDTHS], n, side="right") - 1


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the counts."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def block_keys(words: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of all blocks of lines of n words that begin at first, by line."""
    own, other = width_class(n), width_class(-(-n * 4 // 5))
    lines, keys = [], []
    # running sums are made of the lines of wide blocks alone
    wide = np.flatnonzero(n >= WIDTHS[NARROW][1])
    place = np.zeros(len(n), np.int64)
    place[wide] = np.cumsum(n[wide]) - n[wide]
    sums = bit_sums(words[np.repeat(first[wide], n[wide]) + _ramp(n[wide])]) if len(wide) else None
    for c, (width, _) in enumerate(WIDTHS):
        at = np.flatnonzero((n >= max(LEAST_UNITS, width)) & ((own == c) | (other == c)))
        if not len(at):
            continue
        front = (n[at] + 1) // 2
        for sign, half in ((1, front), (-1, n[at] - front)):
            count = np.minimum(-(-half // width), n[at] // width)
            line, step = np.repeat(at, count), _ramp(count)
            start = step * width if sign > 0 else n[line] - (step + 1) * width
            prints = majority(words, first[line] + start, width) if c < NARROW else simhash(sums, place[line] + start, width)
            tag = ((step * 2 + (sign > 0)) * len(WIDTHS) + c + 1).astype(np.uint64)
            lines.append(line)
            keys.append(mix(prints + mix(tag * _MULT)))
    if not lines:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    line, key = np.concatenate(lines), np.concatenate(keys)
    order = np.argsort(line, kind="stable")
    return line[order], key[order]


def all_keys(lines: Lines, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of the blocks of the lines that are flagged, by line."""
    own = np.where(fresh & (lines.n >= LEAST_UNITS), lines.n, 0)
    line, key = block_keys(lines.words, lines.first, own)
    few = np.flatnonzero(fresh & (lines.n < LEAST_UNITS) & (lines.size >= LEAST_CHARS))
    if len(few):
        letters = [np.frombuffer(lines.normal(k).encode("utf-32-le"), np.uint32).astype(np.uint64) for k in few]
        n = np.array([len(x) for x in letters])
        at, more = block_keys(mix(mix(np.concatenate(letters) + np.uint64(1))), np.cumsum(n) - n, n)
        line, key = np.concatenate((line, few[at])), np.concatenate((key, more))
        order = np.argsort(line, kind="stable")
        line, key = line[order], key[order]
    return line, key


def occurrences(docs: DataFrame) -> DataFrame:
    """``(doc_id, own, line, node, size, keys)`` of the lines with a word; keys are the bytes of longs. What a task has seen
    already has none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces(batches, "text", SLICE):
            lines = Lines(batch.column(1).to_pylist())
            if not len(lines.n):
                continue
            nodes, once = np.unique(lines.node, return_index=True)
            fresh = np.zeros(len(lines.n), bool)
            fresh[[k for node, k in zip(nodes.tolist(), once.tolist()) if node not in seen]] = True
            seen.update(nodes.tolist())
            if len(seen) > SEEN:
                seen.clear()
            line, key = all_keys(lines, fresh)
            cuts = np.concatenate(([0], 8 * np.cumsum(np.bincount(line, minlength=len(fresh))))).astype(np.int32)
            keys = pa.Array.from_buffers(pa.binary(), len(fresh), [None, pa.py_buffer(cuts), pa.py_buffer(key.tobytes())])
            doc_ids, own = (batch.column(k).take(pa.array(lines.text)) for k in (0, 2))
            yield pa.RecordBatch.from_arrays([doc_ids, own, pa.array(lines.number, pa.int32()), pa.array(lines.node), pa.array(lines.size, pa.int32()), keys], ["doc_id", "own", "line", "node", "size", "keys"])

    return docs.select("doc_id", "text", "own" if "own" in docs.columns else F.lit(0).alias("own")).mapInArrow(freed(work), "doc_id long, own int, line int, node long, size int, keys binary")


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, normal, fp)`` of some nodes, which may repeat, and of few others; fp is the SimHash of the whole line. The filter
    that tells which lines may be meant is of a bound size."""
    bits = docs.sparkSession.sparkContext.broadcast(filter_bits(nodes, "node"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value
        seen: set[int] = set()
        for batch in pieces(batches, "text", SLICE):
            lines = Lines(batch.column(0).to_pylist())
            asked = np.flatnonzero(in_filter(held, lines.node))
            nodes, once = np.unique(lines.node[asked], return_index=True)
            once = asked[once]
            hit = np.array([node not in seen for node in nodes.tolist()], bool)
            if hit.any():
                seen.update(nodes[hit].tolist())
                if len(seen) > SEEN:
                    seen.clear()
                normal = pa.array([lines.normal(k) for k in once[hit].tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(nodes[hit]), normal, pa.array(whole_prints(lines, once[hit]))], ["node", "normal", "fp"])

    made = docs.select("text").mapInArrow(freed(work), "node long, normal string, fp long")
    return made.groupBy("node").agg(F.first("normal").alias("normal"), F.first("fp").alias("fp"))


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(node, size, keys)`` with keys as lists. Spark carries them as bytes, as it would take the longs of a list one by one."""
    for batch in batches:
        node, size, keys = batch.columns
        cuts = np.concatenate(([0], np.cumsum(pc.binary_length(keys).fill_null(0).to_numpy(zero_copy_only=False) // 8))).astype(np.int32)
        values = np.frombuffer(b"".join(k for k in keys.to_pylist() if k), np.int64)
        yield pa.RecordBatch.from_arrays([node, size, pa.ListArray.from_arrays(pa.array(cuts), pa.array(values))], ["node", "size", "keys"])


def flat_keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, node and size of each key of a batch ``(node, size, keys)``."""
    node, size, keys = batch.columns
    n = pc.list_value_length(keys).fill_null(0).to_numpy(zero_copy_only=False)
    return keys.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False), np.repeat(node.to_numpy(), n), np.repeat(size.to_numpy(), n).astype(np.int32)


def key_blocks(batches: Iterator[pa.RecordBatch], parts: int, large: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``(part, block)``: the keys that are in no large bucket, with their lines, as a packed block for each part. Keys are
    near random numbers, so that what Spark would do row by row would cost more than the sort."""
    held, count = [], 0
    for batch in chain(batches, (None,)):
        if batch is not None and batch.num_rows:
            bucket, node, size = flat_keys(batch)
            small = ~in_filter(large, bucket)
            held.append((bucket[small], node[small], size[small]))
            count += len(held[-1][0])
        if not count or (batch is not None and count < BLOCK_KEYS):
            continue
        bucket, node, size = (np.concatenate(x) for x in zip(*held))
        part = (bucket.view(np.uint64) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part, bucket, node, size = part[order], bucket[order], node[order], size[order]
        cuts = np.concatenate((np.flatnonzero(np.diff(part, prepend=-1)), [len(part)])).tolist()
        blocks = [bucket[a:b].tobytes() + node[a:b].tobytes() + size[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]]), pa.array(blocks, pa.binary())], ["part", "block"])
        held, count = [], 0


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(bucket, node, size)`` of packed blocks."""
    for batch in batches:
        for block in batch.column(1).to_pylist():
            n = len(block) // 20
            columns = [np.frombuffer(block, np.int64, n), np.frombuffer(block, np.int64, n, 8 * n), np.frombuffer(block, np.int32, n, 16 * n)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "node", "size"])


def filtered_keys(batches: Iterator[pa.RecordBatch], large: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``(node, size, bucket)`` of the keys that may be in a large bucket."""
    for batch in batches:
        bucket, node, size = flat_keys(batch)
        hit = in_filter(large, bucket)
        if hit.any():
            yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(size[hit]), pa.array(bucket[hit])], ["node", "size", "bucket"])


def meetings(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """``(home, bucket, node, size)`` of the lines that have a partner of like length in a bucket; in order of size, a
    partner is next to a line. Buckets take the name of their lines, so that those with the same lines become one. Small
    buckets with one least node share a home, as they hold much the same lines, and a large one is its own."""
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    table = pa.Table.from_batches(tables)
    name, node, size = (table.column(c).to_numpy() for c in ("bucket", "node", "size"))
    del table, tables
    order = np.argsort(name)
    name, node, size = name[order], node[order], size[order]
    same = name[1:] == name[:-1]
    many = np.zeros(len(name), bool)
    many[1:] |= same
    many[:-1] |= same
    name, node, size = name[many], node[many], size[many]
    order = np.lexsort((node, size, name))
    name, node, size = name[order], node[order], size[order]
    once = np.ones(len(name), bool)
    once[1:] = (name[1:] != name[:-1]) | (node[1:] != node[:-1])
    name, node, size = name[once], node[once], size[once]
    chain = np.ones(len(name), bool)
    chain[1:] = (name[1:] != name[:-1]) | (size[:-1] < least * size[1:])
    start = np.flatnonzero(chain)
    if not len(start):
        return
    length = np.diff(np.concatenate((start, [len(name)])))
    title = mix(np.add.reduceat(mix(node.view(np.uint64)), start) + length.astype(np.uint64)).view(np.int64)
    home = np.where(length <= 256, np.minimum.reduceat(node, start), title)
    real = np.repeat(length > 1, length)
    if real.any():
        columns = [np.repeat(home, length)[real], np.repeat(title, length)[real], node[real], size[real]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["home", "bucket", "node", "size"])


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How many characters of each of 32 kinds a text has, and how many runs of three of each of 1024 kinds, up to 255."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = [len(t) for t in texts]
    line = np.repeat(np.arange(len(texts)), length)
    ones = np.bincount(line * 32 + (codes & 31), minlength=32 * len(texts)).reshape(-1, 32).astype(np.int32)
    threes = np.zeros((len(texts), 1024), np.uint8)
    if len(codes) > 2:
        kind = ((codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(22)).astype(np.int64)
        inside = line[:-2] == line[2:]
        cell, count = np.unique(line[:-2][inside] * 1024 + kind[inside], return_counts=True)
        threes.ravel()[cell] = np.minimum(count, 255)
    return ones, threes


#: Bytes of lines that are verified together, and what a line takes for its bags.
LINE_BYTES, ROW_BYTES = 48 << 20, 1200
#: Pairs that are looked at together, and characters that are counted together.
PAIRS = 8192
SLICE_CHARS = 1 << 19
#: Pairs that go through the table of edits together, bytes of their masks, and how much longer than the first the last may be.
STRIPE = 4096
MASK_BYTES = 1 << 26
LIKE_LENGTH = 1.25
#: Pairs whose exact test tells whether most pairs that follow are alike.
FIRST = 32
#: Lines of a bucket up to which buckets of one size are looked at together.
SMALL = 64
_WORD = 64
_ONE, _ALL = np.uint64(1), ~np.uint64(0)


def masks_of(patterns: np.ndarray, letters: int) -> np.ndarray:
    """For each word of 64 places, pattern and letter (the last two as one index) the places where the letter stands."""
    words = -(-patterns.shape[1] // _WORD)
    out = np.zeros((words, len(patterns) * letters), np.uint64)
    base = np.arange(len(patterns)) * letters
    for i in range(patterns.shape[1]):
        out[i // _WORD, base + patterns[:, i]] |= np.uint64(1 << i % _WORD)
    # letter 0 stands for none
    out[:, base] = 0
    return out


def few_edits(masks: np.ndarray, pattern: np.ndarray, n: np.ndarray, texts: np.ndarray, m: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which pairs of a pattern and a text are at most ``most`` edits apart. A column of the table of edits is some words
    of 64 bits that tell where it rises and falls; all pairs take a step together. Only words within ``most`` of the
    diagonal are kept, and a pair ends when no cell of its column can lead to few enough edits. Texts come by length."""
    out = np.zeros(len(m), bool)
    at, reach = np.arange(len(m)), int(most.max())
    up, down = np.full((len(masks), len(m)), _ALL), np.zeros((len(masks), len(m)), np.uint64)
    foot = np.repeat(np.arange(_WORD, _WORD * len(masks) + 1, _WORD)[:, None], len(m), axis=1)
    bottom = reach // _WORD
    for t in range(texts.shape[1]):
        low, high = max(0, (t - reach) // _WORD), min(len(masks) - 1, (t + reach) // _WORD)
        if high > bottom:
            foot[high] = foot[high - 1] + _WORD
        bottom = max(bottom, high)
        cell = pattern + texts[:, t]
        rise_in, fall_in = np.ones(len(m), np.uint64), np.zeros(len(m), np.uint64)
        for w in range(low, high + 1):
            same, rises, falls = masks[w].take(cell), up[w], down[w]
            x = same | falls
            same |= fall_in
            across = (((same & rises) + rises) ^ rises) | same
            rise, fall = falls | ~(across | rises), rises & across
            rise_out, fall_out = rise >> np.uint64(63), fall >> np.uint64(63)
            foot[w] += rise_out.view(np.int64) - fall_out.view(np.int64)
            rise, fall = rise << _ONE | rise_in, fall << _ONE | fall_in
            up[w], down[w] = fall | ~(x | rise), rise & x
            rise_in, fall_in = rise_out, fall_out
        ended = int(np.searchsorted(m, t + 1, side="right"))
        if ended:
            word, bits = (n[:ended] - 1) // _WORD, ((n[:ended] - 1) % _WORD).astype(np.uint64)
            k = np.arange(ended)
            beyond = (_ALL << bits) << _ONE
            score = foot[word, k] - np.bitwise_count(up[word, k] & beyond) + np.bitwise_count(down[word, k] & beyond)
            out[at[:ended]] = score <= most[:ended]
        open_ = np.arange(len(m)) >= ended
        if t % 32 == 31:
            span = slice(low, high + 1)
            least = foot[span] - np.bitwise_count(up[span])
            ahead = (m - t - 1) - (n - np.arange(low * _WORD + 1, high * _WORD + 2, _WORD)[:, None])
            least += np.maximum(np.maximum(ahead, -ahead - (_WORD - 1)), 0)
            # the cell above the first
            above = t + 1 + np.abs(m - t - 1 - n) if low == 0 else most + 1
            open_ &= np.minimum(least.min(axis=0), above) <= most
        left = int(open_.sum())
        if not left:
            break
        if left < len(m) and (ended or left < 0.9 * len(m)):
            at, pattern, n, m, most, texts = at[open_], pattern[open_], n[open_], m[open_], most[open_], texts[open_]
            up, down, foot = up[:, open_], down[:, open_], foot[:, open_]
    return out


class Texts:
    """Some lines, and lower bounds of the edits between them."""

    def __init__(self, texts: list[str]):
        self.length = np.array([len(t) for t in texts])
        self.start = np.cumsum(self.length) - self.length
        # a bound number of characters at a time
        cuts = np.flatnonzero(np.diff(self.start // SLICE_CHARS, prepend=-1)).tolist() + [len(texts)]
        made = [self.slice_of(texts[a:b]) for a, b in zip(cuts, cuts[1:])]
        self.ones, self.threes = (np.concatenate([m[k] for m in made]) for k in (0, 1))
        self.codes = np.concatenate([m[2] for m in made] + [np.zeros(1, np.uint8)])
        self.held = self.threes.sum(axis=1, dtype=np.int64)
        #: texts of characters that have a byte of their own in ``codes``
        self.plain = np.array([t.isascii() or max(t) < "\xff" for t in texts], bool)

    @staticmethod
    def slice_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        return *bags(texts), (codes % np.uint32(255)).astype(np.uint8) + np.uint8(1)

    def part(self, k: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
        """Codes of ``width`` characters from a place of each text k, 0 outside of it."""
        place = start[:, None] + np.arange(width)
        inside = (place >= 0) & (place < self.length[k][:, None])
        return self.codes[np.where(inside, self.start[k][:, None] + place, len(self.codes) - 1)]

    def near(self, q: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which pairs may be at most ``most`` edits apart."""
        at = self.like(q, j, most)
        out = np.zeros(len(q), bool)
        out[at] = self.few(q[at], j[at], most[at])[0]
        return out

    def like(self, q: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Places of the pairs whose characters allow ``most`` edits: an edit takes one away and puts one in at most, and
        three runs of three."""
        kept = []
        for i in range(0, len(q), PAIRS):
            x, y, edits_ = q[i : i + PAIRS], j[i : i + PAIRS], most[i : i + PAIRS]
            more = self.ones[x] - self.ones[y]
            # what one has more is half of all differences and of what it is longer by
            over = np.abs(more).sum(axis=1) + np.abs(self.length[x] - self.length[y])
            at = np.flatnonzero(over <= 2 * edits_)
            union = np.maximum(self.threes[x[at]], self.threes[y[at]]).sum(axis=1, dtype=np.int64)
            kept.append(i + at[union - np.minimum(self.held[x[at]], self.held[y[at]]) <= 3 * edits_[at]])
        return np.concatenate(kept) if kept else np.zeros(0, np.int64)

    def few(self, q: np.ndarray, j: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs may be at most ``most`` edits apart by the table of edits, and which are for certain. Characters that
        share a byte count as equal there, which finds fewer edits and never more; in texts of ``plain`` ones none do."""
        out, sure = np.zeros(len(q), bool), np.zeros(len(q), bool)
        at = np.argsort(self.length[j], kind="stable")
        start = 0
        while start < len(at):
            part = at[start : start + STRIPE]
            # texts of like length, as the longest tell how much of the table is kept
            part = part[: np.searchsorted(self.length[j[part]], LIKE_LENGTH * self.length[j[part[0]]] + _WORD // 2, side="right")]
            words = -(-int(self.length[q[part]].max()) // _WORD)
            part = part[: max(1, MASK_BYTES // (8 * 256 * words))]
            start += len(part)
            reach = int(most[part].max())
            # in few pairs of long texts a step costs more than it does in the exact test
            if len(part) < FIRST * min(words, 2 * reach // _WORD + 2):
                out[part] = True
                continue
            own, which = np.unique(q[part], return_inverse=True)
            out[part] = few_edits(*self.table(own, which), self.length[q[part]], self.part(j[part], 0 * part, int(self.length[j[part]].max())), self.length[j[part]], most[part])
            sure[part] = out[part] & self.plain[q[part]] & self.plain[j[part]]
        return out, sure

    def table(self, own: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Masks of some texts, and where those of each pair begin."""
        return masks_of(self.part(own, 0 * own, int(self.length[own].max())), 256), which * 256


def alike_links(bucket: np.ndarray, size: np.ndarray, prints: np.ndarray, texts: list[str], least: float, far: int = FAR) -> Iterator[tuple[int, int]]:
    """Verified links that join all that verified pairs of each bucket join; rows of one bucket stand together.

    Neighbours in order of text are tried first, and a pair whose ends are joined already needs no test, so that a group
    of like lines costs about one test a line. Other pairs are tested in bound numbers, if their edits can be few enough."""
    root = list(range(len(texts)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    known: dict[str, int] = {}
    name = np.array([known.setdefault(t, len(known)) for t in texts])
    first = np.full(len(known), -1)
    first[name[::-1]] = np.arange(len(texts))[::-1]
    most = (size * (1 - least) + 1e-9).astype(np.int64)
    allowed, length = most.tolist(), [len(t) for t in texts]

    def test(a: int, b: int, exact: bool) -> bool:
        limit = max(allowed[a], allowed[b])
        if abs(length[a] - length[b]) > limit:
            return False
        rough = not parted_early(texts[a], texts[b]) and rough_edits(texts[a], texts[b], limit) <= limit
        return rough or (exact and edits(texts[a], texts[b], limit) <= limit)

    cuts = np.concatenate((np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), [len(bucket)]))
    every = [sorted(set(first[name[a:b]].tolist()), key=lambda k: texts[k]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    for rows in every:
        for a, b in zip(rows, rows[1:]):
            if find(a) != find(b) and test(a, b, False):
                root[find(a)] = find(b)
                yield a, b
    every = [rows for rows in every if len({find(k) for k in rows}) > 1]
    needed = sorted(set(chain.from_iterable(every)))
    place = np.zeros(len(texts), np.int64)
    place[needed] = np.arange(len(needed))
    held = Texts([texts[k] for k in needed]) if needed else None

    def groups() -> np.ndarray:
        return np.array([find(k) for k in range(len(texts))])

    def open_pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # buckets of one size go together if they are small
        sized: dict[int, list[list[int]]] = {}
        for rows in every:
            sized.setdefault(len(rows), []).append(rows)
        for n, own in sized.items():
            rows, (left, right) = np.array(own), np.tril_indices(n, -1) if n <= SMALL else (None, None)
            if n <= SMALL:
                step = max(1, PAIRS // len(left))
                for i in range(0, len(rows), step):
                    yield rows[i : i + step, left].ravel(), rows[i : i + step, right].ravel()
                continue
            step = max(1, PAIRS // n)
            for one in rows:
                for i in range(0, n, step):
                    q, j = np.nonzero(np.arange(i, min(i + step, n))[:, None] > np.arange(n))
                    yield one[q + i], one[j]

    def tried(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int]]:
        q, j = (np.concatenate(x) for x in zip(*parts))
        code = np.unique(np.maximum(q, j) * len(texts) + np.minimum(q, j))
        q, j = code // len(texts), code % len(texts)
        # the likeliest first, as they leave less to test
        order = np.argsort(np.bitwise_count(prints[q] ^ prints[j]), kind="stable")
        q, j = q[order], j[order]
        # where most are alike, they soon are one group and need no bounds
        hits, tests = 1, 1
        while len(q) and 4 * hits >= tests:
            hits, tests = yield from proven(q[:FIRST], j[:FIRST], True)
            q, j = q[FIRST:], j[FIRST:]
        group = groups()
        at = np.flatnonzero(group[q] != group[j])
        at = at[held.like(place[q[at]], place[j[at]], np.maximum(most[q[at]], most[j[at]]))]
        q, j, step = q[at], j[at], STRIPE // 8
        while len(q):
            hits, tests = yield from proven(q[:step], j[:step], False)
            q, j = q[step:], j[step:]
            if 4 * hits < tests:
                step = 4 * STRIPE
            group = groups()
            at = group[q] != group[j]
            q, j = q[at], j[at]

    def proven(q: np.ndarray, j: np.ndarray, bounds: bool) -> Generator[tuple[int, int], None, tuple[int, int]]:
        """The links among some pairs; how many pairs of those that were tested are alike."""
        apart = np.array([find(a) != find(b) for a, b in zip(q.tolist(), j.tolist())], bool)
        q, j = q[apart], j[apart]
        limit = np.maximum(most[q], most[j])
        if bounds:
            like = held.like(place[q], place[j], limit)
            q, j, limit = q[like], j[like], limit[like]
        near, sure = held.few(place[q], place[j], limit)
        hits, tests = int(sure.sum()), len(q)
        for a, b, certain in zip(q[near].tolist(), j[near].tolist(), sure[near].tolist()):
            if find(a) == find(b):
                tests -= not certain
            elif certain or test(a, b, True):
                hits += not certain
                root[find(a)] = find(b)
                yield a, b
        return hits, tests

    parts, count, group = [], 0, groups()
    for q, j in open_pairs():
        # what was joined meanwhile needs no test
        alike = (group[q] != group[j]) & (np.bitwise_count(prints[q] ^ prints[j]) <= far) & (np.minimum(size[q], size[j]) >= least * np.maximum(size[q], size[j]))
        parts.append((q[alike], j[alike]))
        count += len(parts[-1][0])
        if count >= 16 * PAIRS:
            yield from tried(parts)
            parts, count, group = [], 0, groups()
    if parts:
        yield from tried(parts)


def whole_buckets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """About so many bytes of rows at a time, and all of each bucket, whose rows stand together."""
    held, count, goal = [], 0, size
    for batch in chain(batches, (None,)):
        if batch is not None and batch.num_rows:
            held.append(batch)
            count += batch.nbytes + ROW_BYTES * batch.num_rows
        if not held or (batch is not None and count < goal):
            continue
        table = pa.Table.from_batches(held)
        bucket = table.column("bucket").to_numpy()
        ended = np.flatnonzero(bucket != bucket[-1])
        stop = len(bucket) if batch is None else int(ended[-1]) + 1 if len(ended) else 0
        if stop:
            yield table.slice(0, stop)
        held = [b for b in table.slice(stop).to_batches() if b.num_rows]
        count = sum(b.nbytes + ROW_BYTES * b.num_rows for b in held)
        goal = max(size, 2 * count)


def verified_links(docs: DataFrame, found: DataFrame, least: float = LEAST_SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """Links ``(a, b)`` between nodes of ``found(node, size, keys)``: enough to reach all that verified pairs reach."""
    spark = docs.sparkSession
    found = found.select("node", "size", "keys")
    count = (found.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) // 8
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // TASK_ROWS))
    kind, row = "home long, bucket long, node long, size int", "node long, size int, bucket long"
    # what goes row by row: the keys of the nodes from which large buckets are told
    told = found.where(sampled("node")).mapInArrow(lambda b: filtered_keys(listed(b), np.full(1, -1)), row)
    large = settle(large_buckets(told, "node", count, bucket))
    bits = spark.sparkContext.broadcast(filter_bits(large, "bucket"))
    with short_batches(spark, BLOCK_ROWS, BLOCK_BYTES):
        blocks = found.mapInArrow(lambda b: key_blocks(listed(b), parts, bits.value), "part int, block binary")
        met = blocks.repartitionById(parts, "part").mapInArrow(lambda b: meetings(opened(b), least), kind)
        if bits.value.any():
            rest = found.mapInArrow(lambda b: filtered_keys(listed(b), bits.value), row)
            named = dealt(rest, "node", count, bucket, large).select(F.when(F.col("part") == 0, F.col("bucket")).otherwise(F.xxhash64("bucket", "part")).alias("bucket"), "node", "size")
            met = met.unionByName(named.repartition(parts, "bucket").mapInArrow(lambda b: meetings(b, least), kind))
        met = stored(met.distinct(), "meetings")
    texts = texts_of(docs, met.select("node"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[int, int]]:
            for table in whole_buckets(batches, LINE_BYTES):
                bucket, node, size, fp = (table.column(c).to_numpy() for c in ("bucket", "node", "size", "fp"))
                for x, y in alike_links(bucket, size, fp.view(np.uint64), table.column("normal").to_pylist(), least):
                    yield int(node[x]), int(node[y])

        yield from local_forest(edge_batches(pairs()))

    held = met.join(texts, "node").select("home", "bucket", F.lit(0).cast("long").alias("part"), "node", "size", "fp", "normal")
    return held.repartition("home").sortWithinPartitions("home", "bucket").mapInArrow(freed(work), "a long, b long")


#: Words that one line has over another where the two run together again, nearest first.
SHIFTS = sorted(((s, t) for s in range(7) for t in range(7) if s or t), key=lambda x: (max(x), abs(x[0] - x[1])))


def common(a: Sequence, i: int, b: Sequence, j: int) -> int:
    """How far two sequences agree from two places on; found by comparing whole slices."""
    n = min(len(a) - i, len(b) - j)
    if a[i : i + n] == b[j : j + n]:
        return n
    step = 1
    while a[i : i + step] == b[j : j + step]:
        step *= 2
    low, high = step // 2, min(step, n)
    while low + 1 < high:
        middle = (low + high) // 2
        if a[i + low : i + middle] == b[j + low : j + middle]:
            low = middle
        else:
            high = middle
    return low


def parted_early(a: str, b: str) -> bool:
    """Whether ``rough_edits`` gives two lines up where they first differ; looks at no word beyond."""
    same = common(a, 0, b, 0)
    start = a.rfind(" ", 0, same) + 1
    x, y = a[start:].split(" ", 7), b[start:].split(" ", 7)
    return (len(x) > 6 or len(y) > 6) and set(x[:7]).isdisjoint(y[:7])


def rough_edits(a: str, b: str, most: int) -> int:
    """An upper bound of the edit distance by a walk over words, at most ``most + 1``; enough where few words differ."""
    x, y = a.split(" "), b.split(" ")
    i = j = cost = 0
    while True:
        same = common(x, i, y, j)
        i, j = i + same, j + same
        if i >= len(x) or j >= len(y):
            break
        # they can only run together again at a word that both have near by, or at both ends
        if (i + 6 < len(x) or j + 6 < len(y)) and set(x[i : i + 7]).isdisjoint(y[j : j + 7]):
            return most + 1
        for s, t in SHIFTS:
            far = 1 if s == t else 2
            if i + s <= len(x) and j + t <= len(y) and x[i + s : i + s + far] == y[j + t : j + t + far]:
                break
        else:
            return most + 1
        gap, other = sum(map(len, x[i : i + s])) + s - 1, sum(map(len, y[j : j + t])) + t - 1
        cost += max(gap, other) + (not s or not t)
        i, j = i + s, j + t
        if cost > most:
            return most + 1
    rest = sum(map(len, x[i:])) + len(x) - i + sum(map(len, y[j:])) + len(y) - j
    return min(cost + rest, most + 1)


def beyond(up: int, down: int, t: int, n: int, m: int, most: int) -> bool:
    """Whether no cell of column t of the table of n and m letters can lead to at most ``most`` edits. A cell is the first of
    its column and what rises and falls on the way, and leads to no fewer than itself and what the letters left differ in
    number. Neighbours differ by two in this sum at most, so that each sixteenth cell, less 16, stands for those around it."""
    at = n - (m - t)
    low, high = max(0, at - most), min(n, at + most)
    if low > high:
        return True
    for i in (min(max(at, low), high), *range(low, high, 16), high):
        below = (1 << i) - 1
        if t + (up & below).bit_count() - (down & below).bit_count() + abs(at - i) <= most + 16:
            return False
    return True


def edits(a: str, b: str, most: int) -> int:
    """Edit distance, or any number above ``most`` if it is above. A row of the table is two numbers of len(a) bits, so
    that long lines cost their length times a sixty-fourth of it."""
    start = common(a, 0, b, 0)
    a, b = a[start:], b[start:]
    end = common(a[::-1], 0, b[::-1], 0)
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    up, down, held = full, 0, places.get
    for t in range(0, len(b), 32):
        for c in b[t : t + 32]:
            same = held(c, 0)
            x = same | down
            # bits above the last are cut off once, at the end of a step
            y = (((same & up) + up) ^ up) | same
            rise, fall = (down | ~(y | up)) << 1 | 1, (up & y) << 1
            up, down = (fall | ~(x | rise)) & full, rise & x
        if beyond(up, down, min(t + 32, len(b)), len(a), len(b), most):
            return most + 1
    return min(len(b) + up.bit_count() - down.bit_count(), most + 1)


def mark_lines(docs: DataFrame, least: float = LEAST_SIMILARITY, repeated: DataFrame | None = None) -> DataFrame:
    """``(doc_id, own, line, group_id, kept)`` of the lines that take part; equal group_id, same group. ``own`` is that of
    ``common.owned``: rows of one doc_id with different texts are different places of a line."""
    real = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    real = owned(real, repeated_ids(real) if repeated is None else repeated)
    with short_batches(docs.sparkSession):
        found = stored(occurrences(real), "lines")
        linked = components(verified_links(real, found.where("octet_length(keys) > 0"), least), stars=True)
    linked = settle(linked)
    # a line that is neither repeated nor linked is its own group
    several = found.groupBy("node").count().where("count > 1").select("node").unionByName(linked.select("node"))
    tested = maybe_in(found.select("doc_id", "own", "line", "node"), "node", settle(bloom_words(several, "node")))
    alone = tested.where("not __maybe").select("doc_id", "own", "line", F.col("node").alias("group_id"), F.lit(True).alias("kept"))
    rows = stored(tested.where("__maybe").drop("__maybe"), "grouped")
    nodes = rows.groupBy("node").agg(F.min(F.struct("doc_id", "line", "own")).alias("first"))
    named = nodes.join(linked, "node", "left").select("node", "first", F.coalesce("component", "node").alias("group_id"))
    firsts = named.groupBy("group_id").agg(F.min("first").alias("first"))
    groups = named.select("node", "group_id").join(firsts, "group_id")
    kept = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("line") == F.col("first.line")) & (F.col("own") == F.col("first.own"))
    return rows.join(groups, "node").select("doc_id", "own", "line", "group_id", kept.alias("kept")).unionByName(alone)


def remove_lines(docs: DataFrame, least: float = LEAST_SIMILARITY, name: str = "removed_lines") -> DataFrame:
    """The rows of ``docs``, all columns, with ``text`` less the removed lines, and a column of their numbers, in whose
    place a column of that name goes."""
    repeated = repeated_ids(docs)
    gone = mark_lines(docs, least, repeated).where("not kept").groupBy("doc_id", "own").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    gone = settle(gone.select(F.xxhash64("doc_id", "own").alias("key"), F.col("doc_id").alias("of"), F.col("own").alias("of_own"), "lines"))
    kinds = {f.name: f.dataType for f in docs.schema}
    rows = docs.select(packed(docs, "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = owned(rows, repeated).withColumnRenamed("doc_id", "id")
    tested = maybe_in(rows.withColumn("key", F.xxhash64("id", "own")), "key", bloom_words(gone, "key"))
    met = tested.where("__maybe").drop("key").join(gone.drop("key"), (F.col("id") == F.col("of")) & (F.col("own") == F.col("of_own")), "left")
    passed = tested.where("not __maybe").select("row", "text", F.lit(None).cast("array<int>").alias("lines"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            out = []
            for text, lines in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if text is not None and lines:
                    drop = set(lines)
                    text = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in drop)
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), batch.column(2)], ["row", "text", "lines"])

    touched = met.select("row", "text", "lines").mapInArrow(work, T.StructType([T.StructField("row", tested.schema["row"].dataType), T.StructField("text", T.StringType()), T.StructField("lines", T.ArrayType(T.IntegerType()))]))
    of = lambda c: F.col("text").cast(kinds[c]) if c == "text" else F.col("row")[c]
    return touched.unionByName(passed).select(*[of(c).alias(c) for c in docs.columns if c != name], F.col("lines").alias(name))
