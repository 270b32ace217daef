"""Secrets in text: fixed patterns, and a linear-chain conditional random field that adds to them.

The field tags tokens as O (outside), B (begin) or I (inside) of a secret. Its features are a token's own shape, the
kinds of the two tokens before and of the one after, and how much of the file is digits. It is trained on the spans
that the patterns find in about ``TRAIN_DOCS`` documents, chosen by a hash of doc_id (bound: at most ``TRAIN_WINDOWS``
windows reach the driver), by gradient ascent on the exact log-likelihood. Decoding is Viterbi over whole texts: a token
that cannot be B or I whatever stands around it (a bound over all weights) is O on every best path, so that the chain
falls apart there and only the stretches between need the search. Found spans that touch a pattern's span are left out.

A null text is empty. Rows are independent: repeated rows and ties give equal results. Empty input gives no rows; where
no document holds a pattern's span, the field tags nothing.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.llm.common import freed, pieces, settle

TRAIN_DOCS = 20_000
TRAIN_WINDOWS = 4_000
SIDE = 6
KINDS = ("assign", "access", "hex", "crf")
# The patterns.
ASSIGN = re.compile(
    "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    "[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{16,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

TOKEN = re.compile(r"\w+(?:[+/.\-]\w+)*|[^\w\s]+")
O, B, I = 0, 1, 2  # noqa: E741


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches, by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def secret_parts(text: str) -> list[tuple[int, int]]:
    """What is secret in the patterns' matches: the value of an assignment, or the whole match."""
    low = text.lower()
    out = [m.span(2) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12] if any(n in low for n in NAMES) else []
    return out + [(a, b) for a, b, kind in base_spans(text) if kind != "assign"]


# Features. A token has a kind (what its neighbours see) and own features; both depend on the token alone.
SETS = ("letters", "digits", "hex", "lower_digits", "upper_digits", "mixed", "accented", "mark", "quote", "equals", "name")
LENGTHS = (1, 3, 7, 11, 15, 17, 23, 31, 63)
N_SETS, N_LENGTHS = len(SETS), len(LENGTHS) + 1
OWN_PAIR, OWN_TURNS, OWN_ENTROPY, OWN_CASE = 0, N_SETS * N_LENGTHS, N_SETS * N_LENGTHS + 6, N_SETS * N_LENGTHS + 12
N_OWN = N_SETS * N_LENGTHS + 16
PREV, PREV2, NEXT, FILE = N_OWN, N_OWN + N_SETS + 1, N_OWN + 2 * (N_SETS + 1), N_OWN + 3 * (N_SETS + 1)
N_FILE = 4
N_FEATURES = FILE + N_FILE
KEY_LIKE = frozenset(map(SETS.index, ("hex", "lower_digits", "upper_digits", "mixed")))
#: Kinds of key-like tokens and the case that goes with them.
CASES = tuple((SETS.index(x), case) for x, case in (("hex", 0), ("lower_digits", 0), ("upper_digits", 2), ("mixed", 1)))
UNKNOWN_LENGTH = 16
EDGE = N_SETS  # the kind beyond either end


def kind_of(token: str) -> int:
    if not (token[0].isalnum() or token[0] == "_"):
        return SETS.index("equals") if "=" in token or ":" in token else SETS.index("quote") if '"' in token or "'" in token else SETS.index("mark")
    if not token.isascii():
        return SETS.index("accented")
    if token.lower() in NAMES:
        return SETS.index("name")
    if not any(c.isdigit() for c in token):
        return SETS.index("letters")
    bare = re.sub(r"[^A-Za-z0-9]", "", token)
    if bare.isdigit():
        return SETS.index("digits")
    if re.fullmatch("[0-9a-f]+", bare):
        return SETS.index("hex")
    lower, upper = any(c.islower() for c in bare), any(c.isupper() for c in bare)
    return SETS.index("mixed" if lower and upper else "lower_digits" if lower else "upper_digits")


def case_of(token: str) -> int:
    return (2 if token.isupper() else 1 if any(c.isupper() for c in token[1:]) else 0) + (1 if token.startswith("AKIA") else 0)


def own_features(token: str) -> tuple[int, ...]:
    """Plain letters have no entropy feature, so that their features follow from kind, length and case."""
    kind = kind_of(token)
    length = sum(len(token) > n for n in LENGTHS)
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:]))
    counts = [] if token.isalpha() else [token.count(c) / len(token) for c in set(token)]
    entropy = -sum(p * math.log2(p) for p in counts)
    case = case_of(token)
    return (OWN_PAIR + kind * N_LENGTHS + length, OWN_TURNS + min(5, (turns + 1) // 2), OWN_ENTROPY + min(5, int(entropy)), OWN_CASE + min(3, case))


def file_feature(digits: int, length: int) -> int:
    share = digits / max(1, length)
    return FILE + sum(share > x for x in (0.002, 0.02, 0.1))


def token_features(kinds: list[int], i: int, own: tuple[int, ...], file: int) -> list[int]:
    at = lambda j: kinds[j] if 0 <= j < len(kinds) else EDGE
    return [*own, PREV + at(i - 1), PREV2 + at(i - 2), NEXT + at(i + 1), file]


def digits_in(text: str) -> int:
    return sum(map(text.count, "0123456789"))


def training_windows(text: str) -> Iterator[tuple[int, list[int], list[int]]]:
    """(has a secret, features of each token, tags) around secrets and around other tokens with digits.

    Every secret of a text is a centre; of the other tokens with digits one in ceil(n / 64) is, by a hash of its place. A
    window with a long token that looks like a key but matches no pattern teaches nothing, as it may be a secret. A window
    with a secret is given twice: as it is, and with the signs hidden that the patterns look for (names, equals signs and
    quotes beside it, a fixed prefix) and with its letters in another case, so that length, turns, entropy and other
    neighbours carry weight of their own."""
    spots = [m.span() for m in TOKEN.finditer(text)]
    tokens = [text[a:b] for a, b in spots]
    tags = [O] * len(tokens)
    parts = secret_parts(text)
    if parts:
        for k, (a, b) in enumerate(spots):
            for c, d in parts:
                if a < d and c < b and tags[k] == O:
                    tags[k] = I if k and spots[k - 1][1] > c else B
    kinds = [kind_of(t) for t in tokens]
    file = file_feature(digits_in(text), len(text))
    digits = [k for k, t in enumerate(tokens) if tags[k] == O and any(c.isdigit() for c in t)]
    every = -(-len(digits) // 64)
    centres = [k for k in range(len(tokens)) if tags[k] == B] + [k for k in digits if (k * 2654435761 >> 16) % every == 0]
    centres += list(range(0, len(tokens), max(40, len(tokens) // 8)))
    hidden = {SETS.index(x): SETS.index(y) for x, y in (("name", "letters"), ("equals", "mark"), ("quote", "mark"))}
    masked = [hidden.get(x, x) for x in kinds] if any(tags) else kinds
    for j, tag in enumerate(tags):
        if tag and kinds[j] in KEY_LIKE:
            masked[j] = CASES[zlib.crc32(tokens[j].encode()) % len(CASES)][0]
    for k in centres:
        lo, hi = max(0, k - SIDE), min(len(tokens), k + SIDE + 1)
        if any(tags[j] == O and len(tokens[j]) >= UNKNOWN_LENGTH and kinds[j] in KEY_LIKE for j in range(lo, hi)):
            continue
        secret = int(any(tags[lo:hi]))
        for seen in (kinds, masked)[: 1 + secret]:
            features = []
            for j in range(lo, hi):
                own = own_features(tokens[j])
                if seen is not kinds:
                    case = dict(CASES)[seen[j]] if seen[j] in KEY_LIKE and tags[j] else own[3] - OWN_CASE
                    own = (OWN_PAIR + seen[j] * N_LENGTHS + (own[0] - OWN_PAIR) % N_LENGTHS, own[1], own[2], OWN_CASE + case)
                features += token_features(seen, j, own, file)
            yield secret, features, tags[lo:hi]


PER_TOKEN = 8


class Field:
    """Weights of features and of tag pairs."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    @classmethod
    def train(cls, windows: list[tuple[list[int], list[int]]], rounds: int = 100, rate: float = 1.0, ridge: float = 1e-5) -> Field:
        emit, move = np.zeros((N_FEATURES, 3)), np.zeros((3, 3))
        emit[:, O] = 0.01
        if not any(t for _, tags in windows for t in tags):
            emit[:, O] = 1.0
            return cls(emit, move)
        # equal windows count together
        alike: dict[tuple, int] = {}
        for f, t in windows:
            alike[tuple(f), tuple(t)] = alike.get((tuple(f), tuple(t)), 0) + 1
        weight_of, windows = np.array(list(alike.values()), float), list(alike)
        n, longest = len(windows), max(len(t) for _, t in windows)
        feats, tags, real = np.zeros((n, longest, PER_TOKEN), np.int64), np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
        for i, (f, t) in enumerate(windows):
            feats[i, : len(t)], tags[i, : len(t)], real[i, : len(t)] = np.reshape(f, (-1, PER_TOKEN)), t, True
        gold_emit, gold_move = np.zeros_like(emit), np.zeros_like(move)
        each = np.broadcast_to(weight_of[:, None], real.shape)
        np.add.at(gold_emit, (feats[real], tags[real][:, None]), each[real][:, None])
        both = real[:, 1:] & real[:, :-1]
        np.add.at(gold_move, (tags[:, :-1][both], tags[:, 1:][both]), each[:, 1:][both])
        sums = [np.full_like(emit, 1e-8), np.full_like(move, 1e-8)]
        for _ in range(rounds):
            score = emit[feats].sum(axis=2)
            score[~real] = 0
            alpha, beta = np.zeros((n, longest, 3)), np.zeros((n, longest, 3))
            alpha[:, 0] = score[:, 0]
            for t in range(1, longest):
                step = np.logaddexp.reduce(alpha[:, t - 1, :, None] + move, axis=1) + score[:, t]
                alpha[:, t] = np.where(real[:, t, None], step, alpha[:, t - 1])
            for t in range(longest - 2, -1, -1):
                step = np.logaddexp.reduce(move + (score[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
                beta[:, t] = np.where(real[:, t + 1, None], step, 0)
            whole = np.logaddexp.reduce(alpha[:, -1], axis=1)
            tag = np.exp(alpha + beta - whole[:, None, None]) * weight_of[:, None, None]
            want_emit, want_move = np.zeros_like(emit), np.zeros_like(move)
            for k in range(PER_TOKEN):
                for y in range(3):
                    want_emit[:, y] += np.bincount(feats[..., k][real], tag[..., y][real], N_FEATURES)
            pair = np.exp(alpha[:, :-1, :, None] + move + (score + beta)[:, 1:, None, :] - whole[:, None, None, None]) * weight_of[:, None, None, None]
            want_move += pair[both].sum(axis=0)
            for weight, grad, total in ((emit, (gold_emit - want_emit) / weight_of.sum() - ridge * emit, sums[0]), (move, (gold_move - want_move) / weight_of.sum() - ridge * move, sums[1])):
                total += grad * grad
                weight += rate * grad / np.sqrt(total)
        return cls(emit, move)

    def bounds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What each feature adds to a tag over O; the most that context and tag pairs can add, without and with a
        name, an equals sign or a quote next to a token."""
        over = self.emit - self.emit[:, [O]]
        # a tag pair's gain over O on either side; at an end of the text only one side counts
        left = (self.move - self.move[:, [O]]).max(axis=0)
        right = (self.move - self.move[[O], :]).max(axis=1)
        pairs = np.maximum(0, left) + np.maximum(0, right) + over[FILE:].max(axis=0)
        plain = [k for k in range(N_SETS + 1) if k not in SIGNS]
        return over, *(pairs + sum(over[at:][kinds].max(axis=0) for at in (PREV, PREV2, NEXT)) for kinds in (plain, list(range(N_SETS + 1))))

    def scanner(self) -> Scanner:
        return Scanner(self)


#: Kinds that let a secret be likely next to them.
SIGNS = frozenset(SETS.index(x) for x in ("quote", "equals", "name"))
SIGN, NEAR_SIGN, ANYWHERE = 1, 2, 4


class Scanner:
    """Decodes texts; what depends on a token alone is kept, up to a bound."""

    KEPT = 200_000

    def __init__(self, field: Field):
        self.field = field
        self.over, self.plain, self.most = field.bounds()
        self.flags: dict[str, int] = {}
        self.letters: dict[tuple, int] = {}

    def learn(self, token: str) -> int:
        """Whether a token is a sign, and whether it can be B or I at all: next to a sign, or anywhere."""
        alike = None
        if token.isalpha():
            alike = (token.isascii(), min(len(token), 64), 0 if token.islower() else case_of(token), token.lower() in NAMES)
            if alike in self.letters:
                if len(token) <= 64 and len(self.flags) < self.KEPT:
                    self.flags[token] = self.letters[alike]
                return self.letters[alike]
        gain = self.over[list(own_features(token))].sum(axis=0)
        can = lambda most: bool((gain + most)[[B, I]].max() >= 0)
        out = SIGN * (kind_of(token) in SIGNS) | NEAR_SIGN * can(self.most) | ANYWHERE * can(self.plain)
        if alike:
            self.letters[alike] = out
        if len(self.flags) >= self.KEPT:
            self.flags.clear()
        if len(token) <= 64:
            self.flags[token] = out
        return out

    def open_tokens(self, tokens: list[str]) -> list[int]:
        """Places of the tokens that may be B or I on a best path."""
        flags, learn = self.flags, self.learn
        of = [flags[t] if t in flags else learn(t) for t in tokens]
        marked = [i for i, f in enumerate(of) if f & (SIGN | ANYWHERE)]
        out = {i for i in marked if of[i] & ANYWHERE}
        for i in marked:
            if of[i] & SIGN:
                out.update(j for j in (i - 1, i + 1, i + 2) if 0 <= j < len(of) and of[j] & NEAR_SIGN)
        return sorted(out)

    def decode(self, kinds: list[int], tokens: list[str], lo: int, hi: int, file: int) -> list[int]:
        """Best tags of tokens lo to hi - 1; those around them are O."""
        emit, move = self.field.emit, self.field.move
        best, back = None, []
        for k in range(lo, hi):
            score = emit[token_features(kinds, k, own_features(tokens[k]), file)].sum(axis=0)
            if best is None:
                best = score + (move[O] if lo else 0)
            else:
                step = best[:, None] + move
                back.append(step.argmax(axis=0))
                best = step.max(axis=0) + score
        tag = int((best + (move[:, O] if hi < len(tokens) else 0)).argmax())
        out = [tag]
        for b in reversed(back):
            tag = int(b[tag])
            out.append(tag)
        return out[::-1]

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """All spans, by start, then kind as listed."""
        base = base_spans(text)
        tokens = TOKEN.findall(text)
        open_ = self.open_tokens(tokens)
        if not open_:
            return base
        spots = [m.span() for m in TOKEN.finditer(text)]
        near = sorted({j for i in open_ for j in range(max(0, i - 2), min(len(tokens), i + 3))})
        kinds: list[int] = [EDGE] * len(tokens)
        for j in near:
            kinds[j] = kind_of(tokens[j])
        file, found = file_feature(digits_in(text), len(text)), []
        run = 0
        while run < len(open_):
            stop = run + 1
            while stop < len(open_) and open_[stop] == open_[stop - 1] + 1:
                stop += 1
            lo, hi = open_[run], open_[stop - 1] + 1
            run, begun = stop, None
            for k, tag in enumerate(self.decode(kinds, tokens, lo, hi, file) + [O]):
                if begun is not None and tag != I:
                    found.append((spots[begun][0], spots[lo + k - 1][1]))
                    begun = None
                if tag == B or (tag == I and begun is None):
                    begun = lo + k
        # both lists are in order of place
        free, i, reach = [], 0, 0
        for a, b in found:
            while i < len(base) and base[i][0] < b:
                reach = max(reach, base[i][1])
                i += 1
            if a >= reach:
                free.append((a, b, "crf"))
        return sorted(base + free, key=lambda s: (s[0], KINDS.index(s[2])))


def train(docs: DataFrame, docs_bound: int = TRAIN_DOCS, windows_bound: int = TRAIN_WINDOWS) -> Field:
    """Fit the field on the patterns' spans in about ``docs_bound`` documents, at most ``windows_bound`` windows."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    scale = 1 << 30
    chosen = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < int(min(1, docs_bound / max(1, texts.count())) * scale))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows = [(d or 0, n, *w) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for n, w in enumerate(training_windows(t))]
            yield pa.RecordBatch.from_pylist([{"doc_id": d, "n": n, "positive": p, "features": f, "tags": t} for d, n, p, f, t in rows], schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("positive", pa.int32()), ("features", pa.list_(pa.int32())), ("tags", pa.list_(pa.int32()))])
    made = settle(chosen.mapInArrow(freed(windows), "doc_id long, n int, positive int, features array<int>, tags array<int>"))
    # half with secrets and half without, each by a hash and about as many as the bound, which is never passed
    rows, half = [], windows_bound // 2
    counted = {r.positive: r["count"] for r in made.groupBy("positive").count().collect()}
    for positive in (1, 0):
        share = min(1.0, half / max(1, counted.get(positive, 0)))
        picked = made.where((F.col("positive") == positive) & (F.pmod(F.xxhash64("doc_id", "n"), F.lit(scale)) < int(share * scale)))
        rows += picked.select("features", "tags").limit(half).collect()
    return Field.train([(r.features, r.tags) for r in rows if r.tags])


def find_secrets(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``(doc_id, text, found array<struct<start, end, kind>>)`` for every row, spans in code points, end exclusive."""
    field = field or train(docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = field.scanner()
        for batch in pieces(batches, "text"):
            found = [[{"start": a, "end": b, "kind": k} for a, b, k in scanner.spans(t or "")] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], ["doc_id", "text", "found"])

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(freed(work), "doc_id long, text string, found array<struct<start:long,end:long,kind:string>>")


def redact(docs: DataFrame, field: Field | None = None, mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs``, all columns, with every span replaced by ``mark``."""
    field = field or train(docs)
    names = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = field.scanner()
        for batch in pieces(batches, "text"):
            at = batch.schema.get_field_index("text")
            out = []
            for text in batch.column(at).to_pylist():
                spans = scanner.spans(text) if text else ()
                if spans:
                    parts, end = [], 0
                    for a, b, _ in spans:
                        if a >= end:
                            parts += [text[end:a], mark]
                        end = max(end, b)
                    text = "".join(parts) + text[end:]
                out.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(out, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.select(names).mapInArrow(freed(work), docs.schema)
