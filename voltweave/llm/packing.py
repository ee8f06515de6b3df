"""Token ids in packed fixed-length rows.

Texts become byte-pair ids; a document longer than a row is split without loss
into full rows and a rest, and the pieces are packed into rows of ``SEQ_LEN``
ids by best-fit decreasing: the longest piece first, into the open row with the
least room that still takes it, found by descending a segment tree over room.
Packing is done within bounded groups of documents (``GROUP_TOKENS`` ids), so
that no task ever holds more than one group; a group's last rows may stay open
and are filled up with ``PAD``.

A packed row holds the ids (little-endian, 16 bits if the vocabulary allows, else
32), the cumulative segment lengths (0 first, the used length last), the positions
where a segment starts again from its own beginning, and for every segment the
document, the number of its row in the table and its offset in it.  Segments of one
document come back together by (row, offset), even if ids repeat or are null.

Edge cases: null and empty texts make no segment; a null document id is kept as
null; repeated rows are packed like others; a text of any length is only split,
never cut off; an empty table makes no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SEQ_LEN = 2048
#: Ids that a task packs together.
GROUP_TOKENS = 2 << 20
RANKS_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern that the ranks file belongs to.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters given to the tokenizer at once; longer texts are cut there before a space.
PART_CHARS = 1 << 16


def load_ranks(path: str = RANKS_FILE) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_ENCODERS: dict[bytes, object] = {}


def encoder(ranks: bytes):
    """The worker's tokenizer of a ranks file; built once a process."""
    import tiktoken

    name = hashlib.sha256(ranks).digest()
    if name not in _ENCODERS:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _ENCODERS[name] = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _ENCODERS[name]


def end_id(ranks: bytes) -> int:
    """The id that ends every document and fills rows up: the first one that the ranks leave free."""
    return encoder(ranks).max_token_value + 1


def id_type(ranks: bytes) -> str:
    """Little-endian type of the stored ids."""
    return "<u2" if end_id(ranks) < 1 << 16 else "<u4"


def parts(text: str) -> list[str]:
    """A long text in parts that each start at a space followed by a letter or digit, where the pattern splits anyway."""
    out, at = [], 0
    while len(text) - at > PART_CHARS:
        to = at + PART_CHARS
        while to < len(text) - 1 and not (text[to] == " " and text[to + 1].isalnum() and not text[to - 1].isspace()):
            to += 1
        if to >= len(text) - 1:
            break
        out.append(text[at:to])
        at = to
    out.append(text[at:])
    return out


class Room:
    """Segment tree over room: counts rows by room left; finds the least room that is enough."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of a row with the least room of at least ``need``, removed; ``None`` if there is none."""
        i = need + self.size
        if not self.count[i]:
            while i > 1 and not (i % 2 == 0 and self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.size
        row = self.rows[room].pop()
        while i:
            self.count[i] -= 1
            i >>= 1
        return room, row


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Rows of piece numbers, by best-fit decreasing; ties keep their order."""
    rows: list[list[int]] = []
    tree = Room(capacity)
    for piece in np.argsort(-sizes, kind="stable").tolist():
        need = int(sizes[piece])
        found = tree.take(need)
        if found is None:
            room, row = capacity, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(piece)
        if room > need:
            tree.add(room - need, row)
    return rows


def split(size: int, capacity: int) -> list[tuple[int, int]]:
    """(offset, length) of the pieces of a document: full rows, then the rest."""
    return [(at, min(capacity, size - at)) for at in range(0, size, capacity)]


def pack(ids: list[np.ndarray], pad: int, capacity: int = SEQ_LEN) -> list[tuple[np.ndarray, list[int], list[int], list[int]]]:
    """Packed rows of a group: padded ids, cumulative lengths, document number and offset of each segment."""
    pieces = [(d, at, n) for d, x in enumerate(ids) for at, n in split(len(x), capacity)]
    out = []
    for row in best_fit(np.array([n for _, _, n in pieces], np.int64), capacity):
        whole = np.full(capacity, pad, np.int32)
        ends, docs, offsets = [0], [], []
        for k in row:
            d, at, n = pieces[k]
            whole[ends[-1] : ends[-1] + n] = ids[d][at : at + n]
            ends.append(ends[-1] + n)
            docs.append(d)
            offsets.append(at)
        out.append((whole, ends, docs, offsets))
    return out


def pack_documents(documents: DataFrame, ranks: bytes, text: str = "text", key: str = "doc_id", seq_len: int = SEQ_LEN, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Packed rows: ``ids`` (binary), ``cu_seqlens`` (array), ``resets`` (array), ``doc_ids``, ``doc_rows`` and ``doc_offsets`` (arrays), ``n_ids``, ``pad``; no shuffle."""
    kind = documents.schema[key].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(ranks)  # the size of the ranks file
    frame = documents.select(F.col(key).alias("k"), F.col(text).alias("t"), F.monotonically_increasing_id().alias("r"))
    schema = f"ids binary, cu_seqlens array<int>, resets array<int>, doc_ids array<{kind}>, doc_rows array<bigint>, doc_offsets array<int>, n_ids int, pad int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end, stored = encoder(shared.value), end_id(shared.value), id_type(shared.value)
        keys: list = []
        numbers: list[int] = []
        group: list[np.ndarray] = []
        held = 0
        key_type = None

        def rows() -> pa.RecordBatch:
            made = pack(group, end, seq_len)
            used = [r[1][-1] for r in made]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0].astype(stored).tobytes() for r in made], pa.binary()), pa.array([r[1] for r in made], pa.list_(pa.int32())),
                    pa.array([r[1][:-1] for r in made], pa.list_(pa.int32())), pa.array([[keys[d] for d in r[2]] for r in made], pa.list_(key_type)),
                    pa.array([[numbers[d] for d in r[2]] for r in made], pa.list_(pa.int64())), pa.array([r[3] for r in made], pa.list_(pa.int32())), pa.array(used, pa.int32()), pa.array([seq_len - u for u in used], pa.int32()),
                ],
                names=["ids", "cu_seqlens", "resets", "doc_ids", "doc_rows", "doc_offsets", "n_ids", "pad"],
            )

        for b in slices(batches, "t"):
            key_type = b.column("k").type
            for k, t, r in zip(*(b.column(c).to_pylist() for c in "ktr"), strict=True):
                if not t:
                    continue
                x = np.concatenate([*(np.array(own.encode_ordinary(p), np.int32) for p in parts(t)), np.array([end], np.int32)])
                keys.append(k)
                numbers.append(r)
                group.append(x)
                held += len(x)
                if held >= group_tokens:
                    yield rows()
                    keys, numbers, group, held = [], [], [], 0
        if group:
            yield rows()

    return frame.mapInArrow(run, schema)


def unpack(row: dict) -> list[tuple[object, int, int, np.ndarray]]:
    """(document id, row number, offset, ids) of the segments of a packed row."""
    ends = row["cu_seqlens"]
    ids = np.frombuffer(row["ids"], "<u2" if len(row["ids"]) == 2 * (ends[-1] + row["pad"]) else "<u4")
    return [(d, r, at, ids[a:b]) for d, r, at, a, b in zip(row["doc_ids"], row["doc_rows"], row["doc_offsets"], ends, ends[1:], strict=False)]


def position_ids(row: dict) -> np.ndarray:
    """Position of each used id within its segment."""
    ends = np.array(row["cu_seqlens"])
    return np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet; ``ids`` of a file is a row-major id matrix."""
    packed.write.mode("overwrite").parquet(path)
