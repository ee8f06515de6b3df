"""SentencePiece encoding and decoding with batched numpy dynamic programming.

A text is normalised (spaces become U+2581, one in front), cut where no piece
can span a pair of neighbouring characters, and the distinct stretches of equal
length are encoded together: at each position the substrings that end there are
looked up by rolling hash in the sorted piece keys, vectorised maxima pick a
piece for every stretch at once and store the back-pointer, and the pieces are
read off backwards.

Two kinds of model files exist.  For a unigram model a substring adds its score
and the largest sum wins (Viterbi).  For a byte-pair model the sum of scores is
not what the merges compute, so that a plain Viterbi gives other ids than the
model means; there the same recurrence keeps, for every prefix, the last piece
of its one valid encoding: a piece may follow another only if merging the two
pieces' characters would give just these two, which is settled by undoing merges
(pair keys are sorted and probed likewise).  Results equal the merges exactly.

Characters without a piece become byte pieces.  U+2581 in a text is encoded as
bytes too, so that decoding returns every text unchanged.

Edge cases: null has null ids, an empty text no ids; a stretch of thousands of
characters without a cut is encoded alone, step by step; repeated rows are
encoded one by one.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SPACE = "▁"
#: Model file of the queries; a parameter of every function.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Distinct stretches that a worker remembers.
REMEMBERED = 600_000
#: Characters from which a word is cut before it is encoded.
LONG = 32
#: Cells (stretches times length) encoded together.
CELLS = 1 << 20


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        x = shift = 0
        while True:
            b = data[at]
            at += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while at < len(data):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
        elif wire == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if wire == 5 else 8
            yield tag >> 3, data[at : at + n]
            at += n


class _Lookup:
    """Sorted 64-bit keys with values; -1 for unknown keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.int32)
        self.shift = np.uint64(44)
        self.first = np.searchsorted(self.keys >> self.shift, np.arange((1 << 20) + 1, dtype=np.uint64))
        self.full = self.first[1:] > self.first[:-1]
        self.depth = int(np.diff(np.append(self.first[:-1], len(keys))).max(initial=0))

    def get(self, h: np.ndarray) -> np.ndarray:
        """Probe from the start of the key's bucket; buckets hold a few sorted keys each and most are empty."""
        out = np.full(h.shape, -1, np.int32)
        bucket = (h >> self.shift).astype(np.int64)
        row = np.flatnonzero(self.full[bucket])
        h, at = h[row], self.first[bucket[row]]
        for d in range(self.depth):
            pos = np.minimum(at + d, len(self.keys) - 1)
            hit = self.keys[pos] == h
            out[row[hit]] = self.values[pos[hit]]
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(31))
    return x * np.uint64(0x94D049BB133111EB)


class Model:
    """Pieces, scores and merge order of a model file."""

    def __init__(self, file: bytes):
        self.file = file
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.kind, self.prefix, self.squeeze = UNIGRAM, True, True
        for number, value in _fields(file):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.types.append(own.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                own = dict(_fields(value))
                self.prefix, self.squeeze = bool(own.get(3, 1)), bool(own.get(4, 1))
                if own.get(2):
                    raise ValueError("models with a character map are not supported")
        self.unknown = self.types.index(UNKNOWN) if UNKNOWN in self.types else 0
        bytes_ = {p: i for i, p in enumerate(self.pieces) if self.types[i] == BYTE}
        self.byte = [bytes_.get(f"<0x{b:02X}>", self.unknown) for b in range(256)]
        self.usable = {p: i for i, p in enumerate(self.pieces) if self.types[i] in (NORMAL, USER) and p}
        self.tied_in: re.Pattern | None = None
        if self.kind == BPE:
            self._merges()
        self._tables()

    def __reduce__(self):
        return Model, (self.file,)

    # -- byte-pair order ---------------------------------------------------------------------------

    def merge(self, text: str) -> list[int]:
        """Ids of a stretch by the merges themselves: best score first, then leftmost."""
        part: list[str | None] = list(text)
        left, right = list(range(-1, len(part) - 1)), [*range(1, len(part)), -1]
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j != -1 and (made := part[i] + part[j]) in self.usable:
                heapq.heappush(heap, (-self.scores[self.usable[made]], i, made))

        for i in range(len(part) - 1):
            offer(i)
        while heap:
            _, i, made = heapq.heappop(heap)
            if part[i] is None or (j := right[i]) == -1 or part[i] + part[j] != made:
                continue
            part[i], part[j] = made, None
            right[i] = right[j]
            if right[i] != -1:
                left[right[i]] = i
            offer(i)
            if left[i] != -1:
                offer(left[i])
        return [self.usable.get(p, -1) for p in part if p is not None]

    def _merges(self) -> None:
        """Rank of each piece in merge order, and the two pieces its last merge joins; single characters come first and join nothing."""
        n = len(self.pieces)
        self.rank, self.low, self.high = np.full(n, -1, np.int64), np.arange(n), np.arange(n)
        singles = [i for p, i in self.usable.items() if len(p) == 1]
        longer = sorted((i for p, i in self.usable.items() if len(p) > 1), key=lambda i: (-self.scores[i], i))
        same = Counter(self.scores[i] for i in longer)
        tied = [re.escape(self.pieces[i]) for i in longer if same[self.scores[i]] > 1]
        self.tied_in = re.compile("|".join(tied)) if tied else None
        self.rank[singles] = np.arange(len(singles))
        at = len(singles)
        for i in longer:
            split = self._last_merge(self.pieces[i])
            if split is None:  # never the result of merges
                del self.usable[self.pieces[i]]
                continue
            self.low[i], self.high[i] = split
            self.rank[i] = at
            at += 1
        made = np.array([i for i in self.usable.values() if len(self.pieces[i]) > 1], np.int64)
        self.pairs = _Lookup(_mix((self.low[made].astype(np.uint64) << np.uint64(32)) | self.high[made].astype(np.uint64)), made)

    def _last_merge(self, piece: str) -> tuple[int, int] | None:
        """The two parts of a piece before the last merge of its characters; ``None`` if they don't merge to it."""
        if self.merge(piece) != [self.usable[piece]]:
            return None
        own = self.usable.pop(piece)  # without the piece itself the merges stop one step before
        parts = self.merge(piece)
        self.usable[piece] = own
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the characters of a and b leaves just these two, element by element."""
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        rank, low, high = self.rank, self.low, self.high
        while len(live):
            joint = self.pairs.get(_mix((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)))
            bad = (joint >= 0) & (rank[joint] < limit)
            ok[live[bad]] = False
            keep = ~bad
            live, a, b, limit = live[keep], a[keep], b[keep], limit[keep]
            # undo the later merge of the two; a piece that is one character is undone no further
            ra, rb = rank[a], rank[b]
            first = ra > rb
            done = np.zeros(len(live), bool)
            na, nb = high[a], low[b]
            stuck_a, stuck_b = na == a, nb == b
            # undo a if it is later; if it cannot be undone, undo b instead, and the other way round
            use_a = np.where(first, ~stuck_a, stuck_b & ~stuck_a)
            use_b = np.where(first, stuck_a & ~stuck_b, ~stuck_b)
            done = ~use_a & ~use_b
            limit = np.where(use_a, ra, rb + 1)
            a, b = np.where(use_a, na, a), np.where(use_b, nb, b)
            keep = ~done
            live, a, b, limit = live[keep], a[keep], b[keep], limit[keep]
        return ok

    # -- lookup tables -----------------------------------------------------------------------------

    def _tables(self) -> None:
        text = list(self.usable)
        ids = np.array([self.usable[p] for p in text], np.int64)
        self.longest = max(map(len, text), default=0)
        h = np.array([self._hash_one(p) for p in text], np.uint64)
        self.lookup = _Lookup(_mix(h), ids)
        self.score = np.array(self.scores)
        spans = sorted({p[i : i + 2] for p in text for i in range(len(p) - 1)})
        self.spans = set(spans)
        self.inside = np.array(sorted((ord(p[0]) << 21) | ord(p[1]) for p in spans), np.int64)

    @staticmethod
    def _hash_one(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_ODD) + ord(c) + 1) & (2**64 - 1)
        return h

    # -- encoding ----------------------------------------------------------------------------------

    def _batch(self, chars: np.ndarray) -> np.ndarray:
        """Last-piece and length tables turned into ids: (n, L) code points to (n, L) ids, -1 where a piece goes on."""
        n, length = chars.shape
        prefix = np.zeros((length + 1, n), np.uint64)
        for i in range(length):
            prefix[i + 1] = prefix[i] * _ODD + chars[:, i].astype(np.uint64) + np.uint64(1)
        power = np.cumprod(np.append(np.uint64(1), np.full(self.longest, _ODD)), dtype=np.uint64)
        last = np.full((length + 1, n), -1, np.int32)
        back = np.zeros((length + 1, n), np.int32)
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        for i in range(1, length + 1):
            rows = np.arange(n)
            for size in range(min(self.longest, i), 0, -1):
                j = i - size
                whole = len(rows) == n
                piece = self.lookup.get(_mix((prefix[i] - prefix[j] * power[size]) if whole else prefix[i, rows] - prefix[j, rows] * power[size]))
                hit = np.flatnonzero(piece >= 0)
                if not len(hit):
                    continue
                row, piece = rows[hit], piece[hit]
                if self.kind == BPE:
                    if j:
                        before = last[j, row]
                        ok = before < 0  # nothing merges with a character that has no piece
                        some = np.flatnonzero(~ok)
                        ok[some] = self.may_follow(before[some], piece[some])
                        row, piece = row[ok], piece[ok]
                    best[i, row], last[i, row], back[i, row] = size, piece, size
                    if len(row):  # one piece at most is valid: these are settled
                        rows = rows[last[i, rows] < 0]
                else:
                    value = best[j, row] + self.score[piece]
                    ok = value > best[i, row]
                    row = row[ok]
                    best[i, row], last[i, row], back[i, row] = value[ok], piece[ok], size
            lone = best[i] == -np.inf  # a character without a piece
            if lone.any():
                best[i, lone], last[i, lone], back[i, lone] = (0 if self.kind == BPE else best[i - 1, lone] - 1e4), -1, 1
        out = np.full((n, length), -1, np.int64)
        at = np.full(n, length)
        row = np.arange(n)
        while len(row):
            k = at[row]
            start = k - back[k, row]
            piece = last[k, row]
            out[row, start] = np.where(piece >= 0, piece, -2)  # -2: bytes
            at[row] = start
            row = row[start > 0]
        return out

    def encode_stretches(self, stretches: list[str]) -> list[bytes]:
        """Ids, as little-endian int32, of distinct stretches; those of a length advance together."""
        out: list[bytes] = [b""] * len(stretches)
        by: dict[int, list[int]] = {}
        for i, s in enumerate(stretches):
            if self.tied_in and self.tied_in.search(s):  # equal scores: order matters, by the merges
                out[i] = np.array(list(chain.from_iterable(self._spell(s, self.merge(s)))), "<i4").tobytes()
            else:
                by.setdefault(len(s), []).append(i)
        for length, own in by.items():
            step = max(1, CELLS // length)
            for k in range(0, len(own), step):
                part = own[k : k + step]
                chars = np.frombuffer("".join(stretches[i] for i in part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), length)
                ids = self._batch(chars)
                ends = np.cumsum((ids >= 0).sum(axis=1)) * 4
                flat = ids[ids >= 0].astype("<i4").tobytes()
                spelt = set(np.flatnonzero((ids == -2).any(axis=1)).tolist())
                start = 0
                for r, (i, end) in enumerate(zip(part, ends.tolist(), strict=True)):
                    out[i] = flat[start:end]
                    start = end
                    if r in spelt:
                        text = stretches[i]
                        out[i] = np.array(list(chain.from_iterable((x,) if x >= 0 else self._bytes(text[at]) for at, x in enumerate(ids[r].tolist()) if x != -1)), "<i4").tobytes()
        return out

    def _bytes(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte[b] for b in char.encode("utf-8", "surrogatepass"))

    def _spell(self, text: str, ids: list[int]) -> Iterator[tuple[int, ...]]:
        at = 0
        for x in ids:
            if x >= 0:
                at += len(self.pieces[x])
                yield (x,)
            else:
                yield self._bytes(text[at])
                at += 1

    def cut(self, text: str) -> list[str]:
        """Stretches of a long word that pieces cannot span."""
        if len(text) <= LONG:
            return [text]
        at = [0, *(i for i in range(1, len(text)) if text[i - 1 : i + 1] not in self.spans), len(text)]
        return [text[a:b] for a, b in zip(at, at[1:], strict=False)]


_WORD = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


class Codec:
    """Encoder with a bounded memory of stretches, and decoder."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """Ids of each text as little-endian int32; null stays null."""
        model, known = self.model, self.known
        if len(known) > REMEMBERED:
            known.clear()
        words: list[list[str] | None] = []
        seen: set[str] = set()
        for t in texts:
            if not t:
                words.append(None if t is None else [])
                continue
            own: list[str] = []
            for k, part in enumerate(t.split(SPACE)):
                if k:
                    own.append("")  # the sign itself is spelt in bytes
                if part or k == 0:
                    own += _WORD.findall((SPACE if k == 0 and model.prefix else "") + part.replace(" ", SPACE))
            words.append(own)
            seen.update(own)
        known[""] = np.array([model.byte[b] for b in SPACE.encode()], "<i4").tobytes()
        missing = sorted(seen.difference(known))
        parts = [model.cut(w) for w in missing]
        new = list(dict.fromkeys(chain.from_iterable(parts)))
        made = dict(zip(new, model.encode_stretches(new), strict=True))
        for w, own in zip(missing, parts, strict=True):
            known[w] = made[own[0]] if len(own) == 1 else b"".join(map(made.__getitem__, own))
        return [None if own is None else b"".join(map(known.__getitem__, own)) for own in words]

    def decode(self, ids: list[int] | None) -> str | None:
        if ids is None:
            return None
        model = self.model
        if not hasattr(self, "raw"):
            self.raw = [bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(SPACE, " ").encode() if t in (NORMAL, USER) else b"" for p, t in zip(model.pieces, model.types, strict=True)]
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if model.prefix and text.startswith(" ") else text


def load(path: str = MODEL_FILE) -> Model:
    """Read on the driver; workers get the model by broadcast (its size is that of the file)."""
    with open(path, "rb") as f:
        return Model(f.read())


def _run(documents: DataFrame, model: Model, text: str, key: str, columns: str, make):
    kind = documents.schema[key].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(model.file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for b in slices(batches, "t"):
            codec = codec or Codec(_model_of(shared.value))
            made = make(codec, b.column("t").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("k"), *made], names=["k", *(c.split()[0] for c in columns.split(", "))])

    out = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, {columns}")
    return out.withColumnRenamed("k", key)


_MODELS: dict[bytes, Model] = {}


def _model_of(file: bytes) -> Model:
    """The worker's model of a file; built once a process."""
    name = hashlib.sha256(file).digest()
    if name not in _MODELS:
        _MODELS.clear()
        _MODELS[name] = Model(file)
    return _MODELS[name]


def encode_documents(documents: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``ids`` (array of int, null for a null text) and ``n_ids``; no shuffle."""

    def make(codec: Codec, texts: list[str | None]):
        ids = codec.encode(texts)
        size = np.array([0 if x is None else len(x) // 4 for x in ids])
        none = np.array([x is None for x in ids])
        flat = pa.array(np.frombuffer(b"".join(x for x in ids if x), "<i4"))
        ends = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), mask=np.append(none, False))
        return pa.ListArray.from_arrays(ends, flat), pa.array(size, pa.int64(), mask=none)

    return _run(documents, model, text, key, "ids array<int>, n_ids bigint", make)


def decode_documents(encoded: DataFrame, model: Model, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """``key`` and ``text`` again; no shuffle."""
    kind = encoded.schema[key].dataType.simpleString()
    shared = encoded.sparkSession.sparkContext.broadcast(model.file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for b in batches:
            codec = codec or Codec(_model_of(shared.value))
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array([codec.decode(x) for x in part.column("i").to_pylist()], pa.string())], names=["k", "text"])

    out = encoded.select(F.col(key).alias("k"), F.col(ids).alias("i")).mapInArrow(run, f"k {kind}, text string")
    return out.withColumnRenamed("k", key)


def pieces_query(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """``op6``: ids of every whole text as count and digest (little-endian int32), and whether decoding gives the text back."""

    def make(codec: Codec, texts: list[str | None]):
        texts = [t or "" for t in texts]
        ids = codec.encode(texts)
        digest = [hashlib.sha256(x).hexdigest() for x in ids]
        same = [codec.decode(np.frombuffer(x, "<i4").tolist()) == t for x, t in zip(ids, texts, strict=True)]
        return pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(digest, pa.string()), pa.array(same, pa.bool_())

    return _run(documents, model or load(), "text", "doc_id", "n_ids bigint, ids_sha256 string, round_trip boolean", make)
