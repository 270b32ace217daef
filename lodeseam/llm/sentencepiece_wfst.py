"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Four machines are compiled from a model file, as plain arcs: the normaliser (one state, each character to itself, space to
the word sign, and one word sign put before a text that is not empty), the pieces (a trie; an arc that ends a piece gives
its id at the cost of its merge rank), the byte fallback (a character without a piece gives its UTF-8 bytes at a high
cost), and the merge order (a state for each last piece; an arc weighs 0 if merging the joint text of the last and the
next piece gives back just these two, and infinity otherwise). The input is composed with all four as far as it needs: a
state is (place in the text, last piece), and the encoding is the path of least weight in the tropical semiring, where
weights add along a path and the least stays. A sequence of pieces is what BPE's merges make of a text exactly if the
merge order's weights are finite throughout, so the least path is the library's encoding.

All words of a slice that are new are composed together: for one place after the other, every arc that ends there is
relaxed, as columns of numbers. Where no piece holds a word sign after another character the lattice has one state at each
word start, and a word's path is remembered, up to a bound. Words of over 64 characters are relaxed one by one.

A null text encodes to null and decodes to null; an empty one to no ids. Repeated rows are encoded alike. Empty input
gives no rows. The path of the model is a parameter. Models with other normalisers or of other types are refused.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.llm.common import pieces

SIGN = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
INFINITE = float("inf")
START = 0
CHUNK = re.compile(f"{SIGN}+[^{SIGN}]*|[^{SIGN}]+")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and contents of the fields of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Arc(NamedTuple):
    """An arc of a compiled machine: what it reads, what it gives, its weight, and the states it joins."""

    source: int
    reads: str
    gives: tuple | str
    weight: float
    target: int


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


_STEP = 0xD6E8FEB86659FD93
#: Weight of a character that falls back to bytes: above that of any pieces of one word.
FALLBACK = 1e6


class PieceTable:
    """Finds pieces by the hash of their characters; hashes that share a slot have their own second table."""

    SLOTS = 20

    def __init__(self, names: list[str]):
        self.longest = max(map(len, names), default=1)
        self.hashes = np.array([self.hash_of(x) for x in names] or [0], np.uint64)
        if len(set(self.hashes.tolist())) < len(names):
            raise ValueError("two pieces share a hash")
        self.first, self.second = (np.full(1 << self.SLOTS, -1, np.int32) for _ in range(2))
        for k, (a, b) in enumerate(zip(self.slot(self.hashes, 0).tolist(), self.slot(self.hashes, self.SLOTS).tolist())):
            if k < len(names):
                table, at = (self.first, a) if self.first[a] < 0 else (self.second, b)
                if table[at] >= 0:
                    raise ValueError("two pieces share both slots")
                table[at] = k

    @classmethod
    def slot(cls, hashes: np.ndarray, skip: int) -> np.ndarray:
        return (hashes >> np.uint64(64 - cls.SLOTS - skip)).astype(np.int64) & ((1 << cls.SLOTS) - 1)

    @staticmethod
    def letters(codes: np.ndarray) -> np.ndarray:
        return mix(mix(codes.astype(np.uint64) + np.uint64(1)))

    @classmethod
    def hash_of(cls, name: str) -> int:
        values = cls.letters(np.array([ord(c) for c in name])).tolist()
        return int(mix(np.array([sum(v * pow(_STEP, k, 1 << 64) for k, v in enumerate(values)) % (1 << 64)], np.uint64))[0])

    def find(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each length the numbers of the pieces that begin at each place of each row, -1 for none."""
        values = self.letters(codes)
        out, held = [], np.zeros_like(values)
        for length in range(1, min(self.longest, codes.shape[1]) + 1):
            width = codes.shape[1] - length + 1
            held = held[:, :width] + values[:, length - 1 :] * np.uint64(pow(_STEP, length - 1, 1 << 64))
            hashes = mix(held)
            found = self.first[self.slot(hashes, 0)]
            wrong = (found >= 0) & (self.hashes[found] != hashes)
            if wrong.any():
                other = self.second[self.slot(hashes[wrong], self.SLOTS)]
                found[wrong] = np.where((other >= 0) & (self.hashes[other] == hashes[wrong]), other, -1)
            out.append(found)
        return out


class Transducer:
    """Encodes and decodes with one model."""

    KEPT = 300_000
    #: Slots for weights of the merge order that were asked for; a slot keeps the last.
    PAIRS = 1 << 21
    CELLS = 1 << 16
    LONG = 64

    def __init__(self, path: str):
        with open(path, "rb") as file:
            data = file.read()
        self.names: list[str] = []
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes_: dict[int, int] = {}
        self.kinds: list[int] = []
        for field, value in _fields(data):
            if field == 1:
                self._piece(dict(_fields(value)))
            elif field == 2 and dict(_fields(value)).get(3, 1) != 2:
                raise ValueError("only BPE models are supported")
            elif field == 3:
                spec = dict(_fields(value))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("only the identity normaliser is supported")
                self.prefix = bool(spec.get(3, 1))
        self.byte_values = {i: b for b, i in self.bytes_.items()}
        self.by_word = not any(SIGN in name.lstrip(SIGN) for name in self.ids)
        self.words: dict[str, list[int]] = {}
        self.histories: dict[str, tuple] = {}
        self.fallen: dict[str, Arc] = {}
        # what the machines' arcs say, by what they read
        self.mapped = {arc.reads: arc.gives for arc in self.normaliser_arcs() if arc.reads}
        ends = [arc for arc in self.piece_arcs() if arc.gives]
        self.pieces = [self.names[arc.gives[0]] for arc in ends]
        self.piece_ids = np.array([arc.gives[0] for arc in ends], np.int64)
        self.piece_costs = np.array([arc.weight for arc in ends])
        self.number = {name: k for k, name in enumerate(self.pieces)}
        self.table = PieceTable(self.pieces)
        self.pair_keys = np.full(self.PAIRS, -1, np.int64)
        self.pair_weights = np.zeros(self.PAIRS)
        self.shown = [bytes([self.byte_values[i]]) if k == BYTE else b"" if k == CONTROL else n.encode("utf-8") for i, (n, k) in enumerate(zip(self.names, self.kinds))]

    def normaliser_arcs(self) -> list[Arc]:
        """All characters but these map to themselves."""
        return [Arc(0, "", SIGN if self.prefix else "", 0.0, 1), Arc(1, " ", SIGN, 0.0, 1)]

    def piece_arcs(self) -> list[Arc]:
        """The trie of pieces; an arc that gives a piece returns to the start. What merges never leave has no such arc."""
        best = max(self.scores.values(), default=0.0)
        states, arcs = {"": START}, []
        for name, i in self.ids.items():
            if self.merge(name) != [name]:
                continue
            for k in range(1, len(name)):
                if name[:k] not in states:
                    states[name[:k]] = len(states)
                    arcs.append(Arc(states[name[: k - 1]], name[k - 1], (), 0.0, states[name[:k]]))
            arcs.append(Arc(states[name[:-1]], name[-1], (i,), best - self.scores[name], START))
        return arcs

    def byte_arc(self, char: str) -> Arc:
        """The byte fallback's arc for one character."""
        known = self.fallen.get(char)
        if known is not None:
            return known
        if len(self.fallen) >= self.KEPT:
            self.fallen.clear()
        ids = tuple(self.bytes_[b] for b in char.encode("utf-8")) if self.bytes_ else (self.kinds.index(UNKNOWN),)
        self.fallen[char] = Arc(START, char, ids, FALLBACK, START)
        return self.fallen[char]

    def _piece(self, fields: dict) -> None:
        name, kind = fields[1].decode("utf-8"), fields.get(3, NORMAL)
        i = len(self.names)
        self.names.append(name)
        self.kinds.append(kind)
        if kind == BYTE:
            self.bytes_[int(name[3:5], 16)] = i
        elif kind in (NORMAL, USER):
            self.ids[name] = i
            self.scores[name] = float(np.frombuffer(fields[2], "<f4")[0]) if 2 in fields else 0.0

    def merge(self, text: str) -> list[str]:
        """BPE of a short text: the best neighbours join first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def history(self, name: str) -> tuple[list[tuple[float, str]], list[tuple[float, str]]]:
        """The merges that make a piece, in order: their scores with the first part left by each, and with the last."""
        known = self.histories.get(name)
        if known is None:
            parts, first, last = list(name), [], []
            while len(parts) > 1:
                score, at = max(((self.scores.get(x + y, -INFINITE), -i) for i, (x, y) in enumerate(zip(parts, parts[1:]))))
                parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
                first.append((score, parts[0]))
                last.append((score, parts[-1]))
            known = self.histories[name] = (first, last)
        return known

    def weight(self, last: str, piece: str) -> float:
        """Weight of the merge order's arc from one piece to the next: infinity if, with both made merge by merge, a merge
        across their border has its turn, else 0. Of equal merges the leftmost comes first."""
        before, after = self.history(last)[1], self.history(piece)[0]
        i = j = 0
        a, b = last[-1], piece[0]
        while True:
            across = self.scores.get(a + b, -INFINITE)
            left = before[i][0] if i < len(before) else -INFINITE
            right = after[j][0] if j < len(after) else -INFINITE
            if i < len(before) and left >= across and left >= right:
                a = before[i][1]
                i += 1
            elif across > -INFINITE and across >= right:
                return INFINITE
            elif j < len(after):
                b = after[j][1]
                j += 1
            else:
                return 0.0

    def order_weights(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """The same for numbers of pieces; a last number below 0 is the start or a character that fell back to bytes, after
        which everything may follow."""
        key = last * (1 << 32) + piece
        slot = (mix(key.view(np.uint64)) >> np.uint64(20)).astype(np.int64) & (self.PAIRS - 1)
        out = self.pair_weights[slot]
        missed = np.flatnonzero((self.pair_keys[slot] != key) & (last >= 0))
        if len(missed):
            keys, back = np.unique(key[missed], return_inverse=True)
            made = np.array([self.weight(self.pieces[k >> 32], self.pieces[k & 0xFFFFFFFF]) for k in keys.tolist()])
            out[missed] = made[back]
            self.pair_keys[slot[missed]], self.pair_weights[slot[missed]] = key[missed], out[missed]
        return np.where(last >= 0, out, 0.0)

    def relaxed(self, words: list[str]) -> Iterator[list[int]]:
        """Ids on the least path of each normalised text; the texts are sorted from long to short."""
        n = np.array([len(w) for w in words])
        codes = np.zeros((len(words), int(n[0])), np.uint32)
        codes[np.arange(codes.shape[1]) < n[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        found = self.table.find(codes)
        cost = np.full((len(words), codes.shape[1] + 1), INFINITE)
        state = np.full(cost.shape, -1, np.int64)
        before = np.zeros(cost.shape, np.int32)
        cost[:, 0] = 0
        for place in range(1, codes.shape[1] + 1):
            rows = int(np.searchsorted(-n, -place, side="right"))
            # the byte fallback's arcs
            bare = np.flatnonzero(found[0][:rows, place - 1] < 0)
            cost[bare, place], before[bare, place] = cost[bare, place - 1] + FALLBACK, place - 1
            for length in range(1, min(len(found), place) + 1):
                start = place - length
                piece = found[length - 1][:rows, start]
                at = np.flatnonzero(piece >= 0)
                if len(at):
                    piece = piece[at].astype(np.int64)
                    total = cost[at, start] + self.piece_costs[piece] + self.order_weights(state[at, start], piece)
                    less = total < cost[at, place]
                    at, piece = at[less], piece[less]
                    cost[at, place], state[at, place], before[at, place] = total[less], piece, start
        # from the end of each path to its start, then turned round
        row, spot, steps = np.arange(len(words)), n.copy(), []
        while len(row):
            steps.append((row, state[row, spot], before[row, spot]))
            spot = before[row, spot].astype(np.int64)
            row, spot = row[spot > 0], spot[spot > 0]
        row, piece, start = (np.concatenate(x[::-1]) for x in zip(*steps))
        order = np.argsort(row, kind="stable")
        row, piece, start = row[order], piece[order], start[order]
        ids = np.where(piece >= 0, self.piece_ids[piece], -1).tolist()
        cuts = np.searchsorted(row, np.arange(len(words) + 1)).tolist()
        plain = np.ones(len(words), bool)
        plain[row[piece < 0]] = False
        start = start.tolist()
        for k, (word, simple) in enumerate(zip(words, plain.tolist())):
            own = ids[cuts[k] : cuts[k + 1]]
            if not simple:
                own = [i for j, x in zip(range(cuts[k], cuts[k + 1]), own) for i in ((x,) if x >= 0 else self.byte_arc(word[start[j]]).gives)]
            yield own

    def shortest_path(self, text: str) -> list[int]:
        """Ids on the least path of one normalised text of any length, relaxed state by state."""
        longest, number = self.table.longest, self.number
        cost, state, before = [0.0], [-1], [0]
        for place in range(1, len(text) + 1):
            best = (INFINITE, -1, place - 1)
            if text[place - 1] not in number:
                best = (cost[-1] + FALLBACK, -1, place - 1)
            for start in range(max(0, place - longest), place):
                piece = number.get(text[start:place])
                if piece is not None:
                    last = state[start]
                    total = cost[start] + float(self.piece_costs[piece])
                    if total < best[0] and (last < 0 or self.order_weights(np.array([last]), np.array([piece]))[0] == 0):
                        best = (total, piece, start)
            for part, value in zip((cost, state, before), best):
                part.append(value)
        out, place = [], len(text)
        while place:
            out += self.byte_arc(text[place - 1]).gives[::-1] if state[place] < 0 else (int(self.piece_ids[state[place]]),)
            place = before[place]
        return out[::-1]

    def shortest_paths(self, texts: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Normalised texts, which are not empty, with the ids on their least paths, in an order of their own."""
        by_length = sorted(texts, key=len, reverse=True)
        at = 0
        while at < len(by_length) and len(by_length[at]) > self.LONG:
            yield by_length[at], self.shortest_path(by_length[at])
            at += 1
        while at < len(by_length):
            stop = at + max(1, self.CELLS // len(by_length[at]))
            yield from zip(by_length[at:stop], self.relaxed(by_length[at:stop]))
            at = stop

    def normalise(self, text: str) -> str:
        """The text composed with the normaliser, whose arcs but one keep what they read."""
        for reads, gives in self.mapped.items():
            text = text.replace(reads, gives)
        return (SIGN if self.prefix and text else "") + text

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        texts = [self.normalise(t) for t in texts]
        if not self.by_word:
            return [self.shortest_path(t) for t in texts]
        split = [CHUNK.findall(t) for t in texts]
        words = self.words
        if len(words) >= self.KEPT:
            words.clear()
        fresh = set().union(*split).difference(words)
        words.update(self.shortest_paths(list(fresh)))
        out = [list(chain.from_iterable(map(words.__getitem__, line))) for line in split]
        for w in fresh:
            if len(w) > self.LONG:
                del words[w]
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The inverse path: bytes join to characters (what is no UTF-8 becomes U+FFFD), word signs to spaces."""
        text = b"".join(map(self.shown.__getitem__, ids)).decode("utf-8", "replace")
        text = text.replace(SIGN, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


@lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    """Compiled once for each Python worker."""
    return Transducer(path)


def encode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>)`` for every row."""
    path = path or model_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = transducer(path)
        for batch in pieces(batches, "text", 2 << 20):
            texts = batch.column(1).to_pylist()
            found = made.encode_batch([t or "" for t in texts])
            ids = [None if t is None else x for t, x in zip(texts, found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(work, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``."""
    path = path or model_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = transducer(path)
        for batch in batches:
            texts = [None if x is None else made.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, n_ids, n_byte_ids, ids_crc32, same_text)`` for every row: encoded, and decoded again in the same task.

    A text that holds the word sign itself comes back with a space in its place, as in the library."""
    import zlib

    path = path or model_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = transducer(path)
        low, high = min(made.byte_values, default=0), max(made.byte_values, default=-1)
        for batch in pieces(batches, "text", 2 << 20):
            rows = []
            texts = batch.column(1).to_pylist()
            for doc_id, text, ids in zip(batch.column(0).to_pylist(), texts, made.encode_batch([t or "" for t in texts])):
                if text is None:
                    rows.append((doc_id, None, None, None, None))
                    continue
                block = np.array(ids, "<u4")
                rows.append((doc_id, len(ids), int(((block >= low) & (block <= high)).sum()), zlib.crc32(block.tobytes()), made.decode(ids) == text))
            kinds = [pa.int64()] * 4 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "same_text"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(work, "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, same_text boolean")
