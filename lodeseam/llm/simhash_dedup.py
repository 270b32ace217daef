"""SimHash near-duplicates, linked through a hierarchical index over Gray-ordered fingerprints.

Fingerprints that differ in at most ``BITS`` = 2 bits agree on two of four 16-bit blocks, so each distinct fingerprint
goes to six buckets, and every link lies in at least one of them. Inside a bucket the fingerprints stand in Gray order,
where neighbours differ in few bits. Runs of neighbours share an upper node that holds the bits on which all agree (a
mask and a pattern); upper nodes are grouped again. A search adds up the differences on each node's own bits from the
top down and leaves a whole group as soon as the sum passes two. Buckets above ``BUCKET`` fingerprints are cut into
parts, and each pair of parts is a task of its own, so that no link is lost and no task grows with a bucket.

Nulls: a null text has no words, fingerprint zero, and is linked like any other; rows without a doc_id are their own
group with a null component. Repeated doc_ids are rows of one document. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseam.llm.common import components, local_forest, pieces, settle

SEED = 42
BITS = 2
#: Fingerprints of a bucket that one task compares; larger buckets are cut.
BUCKET = 4096
#: Children of an index node.
FAN = 8


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of a text's word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (np.concatenate(([0], ends[:-1])))[: len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    total, counts = len(starts), np.zeros(64, np.int64)
    for i in range(0, total, 32768):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + 32768], stops[i : i + 32768])], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)`` for every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            made = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Places of codes in Gray order."""
    for step in (1, 2, 4, 8, 16, 32):
        codes = codes ^ (codes >> np.uint64(step))
    return codes


class GrayIndex:
    """Upper nodes over codes in Gray order; every node keeps only the bits that its parent lacks."""

    def __init__(self, codes: np.ndarray):
        full = np.full(len(codes), ~np.uint64(0), np.uint64)
        levels = [(codes, full)]
        while len(levels[-1][0]) > FAN:
            pattern, mask = levels[-1]
            cuts = np.arange(0, len(pattern), FAN)
            every = np.bitwise_and.reduceat(pattern & mask, cuts)
            some = np.bitwise_or.reduceat(pattern | ~mask, cuts)
            kept = np.bitwise_and.reduceat(mask, cuts) & ~(every ^ some)
            levels.append((every & kept, kept))
        self.levels = [(p, m & ~(levels[i + 1][1][np.arange(len(p)) // FAN] if i + 1 < len(levels) else np.uint64(0))) for i, (p, m) in enumerate(levels)]

    def near(self, codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, place) at most ``bits`` apart."""
        pattern, own = self.levels[-1]
        query = np.repeat(np.arange(len(codes)), len(pattern))
        node = np.tile(np.arange(len(pattern)), len(codes))
        far = np.zeros(len(query), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            pattern, own = self.levels[level]
            far = far + np.bitwise_count((codes[query] ^ pattern[node]) & own[node])
            keep = far <= bits
            query, node, far = query[keep], node[keep], far[keep]
            if level:
                below = len(self.levels[level - 1][0])
                query, far = np.repeat(query, FAN), np.repeat(far, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                inside = node < below
                query, node, far = query[inside], node[inside], far[inside]
        return query, node


def pairs_within(codes: np.ndarray, bits: int) -> Iterator[tuple[int, int]]:
    """Pairs (i, j), j before i, of places whose codes are at most ``bits`` apart; codes are in Gray order."""
    if len(codes) <= 24:
        plain = codes.tolist()
        yield from ((i, j) for i in range(len(plain)) for j in range(i) if (plain[i] ^ plain[j]).bit_count() <= bits)
        return
    index = GrayIndex(codes)
    for i in range(0, len(codes), 1024):
        query, place = index.near(codes[i : i + 1024], bits)
        query = query + i
        yield from zip(query[place < query].tolist(), place[place < query].tolist())


def forest(codes: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that join all codes of one bucket that are reachable within it: a spanning forest of places."""
    root = list(range(len(codes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    for i, j in pairs_within(codes, bits):
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            links.append((i, j))
    return links


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The rows of each bucket and part, which stand together, as arrays; runs of one row are left out."""
    names = ("bucket", "part")

    def close(table: pa.Table) -> Iterator[dict[str, np.ndarray]]:
        change = np.zeros(table.num_rows, bool)
        columns = {c: table.column(c).to_numpy() for c in table.schema.names}
        for c in names:
            change[1:] |= columns[c][1:] != columns[c][:-1]
        cuts = np.concatenate(([0], np.flatnonzero(change), [table.num_rows]))
        for i in np.flatnonzero(np.diff(cuts) > 1):
            yield {c: v[cuts[i] : cuts[i + 1]] for c, v in columns.items()}

    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        same = np.ones(table.num_rows, bool)
        for c in names:
            column = table.column(c).to_numpy()
            same &= column == column[-1]
        first = int(np.argmax(same))
        if first:
            yield from close(table.slice(0, first))
        held = table.slice(first).combine_chunks()
    if held is not None:
        yield from close(held)


def edge_batches(found: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for x, y in found:
        a.append(x)
        b.append(y)
        if len(a) >= 100_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a, b = [], []
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def bucket_links(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links inside each bucket and part, whose rows are put in Gray order first."""

    def found() -> Iterator[tuple[int, int]]:
        for run in runs(batches):
            codes = run["fp"].view(np.uint64)
            order = np.argsort(gray_rank(codes), kind="stable")
            node = run["node"][order]
            for x, y in forest(codes[order], bits):
                yield int(node[x]), int(node[y])

    yield from edge_batches(found())


#: Buckets are told to be large from one fingerprint in SAMPLE, and at most LARGE of them are. Which rows meet doesn't
#: depend on it, only in how many tasks.
SAMPLE, LARGE = 64, 10_000


def bucketed(codes: DataFrame, widths: tuple[int, ...], bucket: int) -> DataFrame:
    """``codes(node, fp, size)`` once for each pair of equal blocks, in parts of about ``bucket`` rows that meet in pairs.

    Fingerprints that differ in fewer blocks than len(widths) - 1 share a bucket."""
    starts = [sum(widths[:i]) for i in range(len(widths))]
    block = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in zip(starts, widths)]
    pairs = [(i, j) for i in range(len(widths)) for j in range(i)]
    names = [F.lit(t).cast("long") * F.lit(1 << 48) + F.shiftleft(block[i], widths[j]) + block[j] for t, (i, j) in enumerate(pairs)]
    rows = codes.select("node", "fp", "size", F.explode(F.array(*names)).alias("bucket"))
    return parted(rows, codes.count() * len(pairs), bucket)


def sampled(by: str) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(SAMPLE)) == 0


def large_buckets(rows: DataFrame, by: str, count: int, bucket: int) -> DataFrame:
    """``(bucket, about)`` of the buckets that have more than about ``bucket`` of the rows; about LARGE of them at most."""
    seen = rows.where(sampled(by)).groupBy("bucket").agg((F.count(F.lit(1)) * SAMPLE).alias("about"))
    return seen.where(F.col("about") >= max(bucket, count / LARGE))


def dealt(rows: DataFrame, by: str, count: int, bucket: int, large: DataFrame | None = None) -> DataFrame:
    """``rows``, of about that count, with a column ``part``: 0, or for a bucket of more than about ``bucket`` rows each
    pair of parts that a row belongs to by the hash of column ``by``, so that any two rows of a bucket share one."""
    large = F.broadcast(large_buckets(rows, by, count, bucket) if large is None else large)
    own = F.pmod(F.hash(by), F.col("parts"))
    meet = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.least(own, other).cast("long") * F.lit(1 << 31) + F.greatest(own, other) + 1)
    marked = rows.join(large, "bucket", "left").withColumn("parts", F.coalesce(F.ceil(F.col("about") / bucket), F.lit(1)).cast("int"))
    return marked.select(*rows.columns, F.explode(F.when(F.col("parts") > 1, meet).otherwise(F.array(F.lit(0).cast("long")))).alias("part"))


def parted(rows: DataFrame, count: int, bucket: int) -> DataFrame:
    """``rows(node, fp, size, bucket)``, of about that count, in parts of about ``bucket`` rows that meet in pairs."""
    split = dealt(rows, "fp", count, bucket).select("bucket", "part", "fp", "node", "size")
    return split.repartition("bucket", "part").sortWithinPartitions("bucket", "part")


def near_links(codes: DataFrame, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """Links ``(a, b)`` between the nodes of ``codes(node, fp)``, distinct fingerprints: enough to reach all that is
    reachable by steps of at most ``bits`` (2 at most) differing bits."""
    if not 0 <= bits <= 2:
        raise ValueError("four blocks of 16 bits find at most two differing bits")
    return bucketed(codes.select("node", "fp", F.lit(1).alias("size")), (16, 16, 16, 16), bucket).mapInArrow(lambda batches: local_forest(bucket_links(batches, bits)), "a long, b long")


def groups(docs: DataFrame, shingle: int = 3, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row; component_id is the least doc_id reachable over links."""
    marked = settle(fingerprints(docs, shingle))
    codes = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("node")))
    linked = components(near_links(codes.where("node is not null"), bits, bucket), stars=True)
    named = codes.join(linked, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
