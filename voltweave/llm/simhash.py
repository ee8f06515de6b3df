"""SimHash near-dedup over a Gray-order hierarchical index.

A document's fingerprint has a bit set where over half of its shingle hashes
have it.  Distinct fingerprints within ``RADIUS`` differing bits are linked and
links are closed into components; exact copies share a fingerprint, so only
distinct ones are compared.

Finding links: 64 bits are cut into blocks such that two linked fingerprints
agree on some combination of whole blocks (pigeonhole), and each combination is
a bucket key.  A bucket of more than ``BUCKET_ROWS`` fingerprints is split into
chunks, and each pair of chunks is a work unit, so that one bucket never has to
fit one task.  Inside a unit the fingerprints are sorted by Gray rank and form a
tree whose nodes hold the bits shared by their members; bits shared in a parent
are factored out of its children.  A query walks down, adding up the differing
bits; a node above ``RADIUS`` is pruned with its group, a node that cannot get
above it is accepted with its group, and a group that already shares the query's
component is skipped.  A unit reports one link per fingerprint to a
representative, never all pairs.

``keep_one`` removes near-duplicates, texts whose five-word shingles have a similarity
of about 0.8 or more.  Their 64-bit fingerprints of shingles often differ in ten bits or
more, too many for an index.  So its fingerprints are taken over distinct words, of
which an edit changes one where it changes five shingles; texts within
``NEAR_RADIUS`` bits are candidates, and a candidate is a link if the wide signatures
(``WIDE`` bits over five-word shingles) differ in ``WIDE_LIMIT`` bits at most, which is
checked at the leaves of the same index.  Unlike an exact count this is an estimate.

Edge cases: null counts as empty; texts without words have fingerprint zero and
are linked like others; rows with a null id get a fingerprint and the smallest
non-null id of their component (null if there is none); repeated rows and ids
stay as they are; an empty table gives an empty result.  A fingerprint, bucket or
node that very many rows share never gathers in one task (``hot_join``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT_ROWS, buffers, cut, hot_join, settle, slices

#: Words of a shingle, seed of its XXH64, and differing bits up to which fingerprints are linked.
SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints of a chunk; a larger bucket is split.
BUCKET_ROWS = 2048
#: Fingerprints that a task indexes at once, and (query, node) pairs that it holds at once.
UNIT_ROWS, FRONTIER = 1 << 15, 1 << 20
#: Links that one task closes into components, as arrays (some 200 MB); more take rounds of joins.
TASK_LINKS = 1 << 21
#: For near-duplicates: differing bits of candidates, words of a shingle, and bits and greatest difference of the signature that
#: confirms them (at a similarity of 0.8 the mean is 39 bits with a deviation of 6, at 0.7 it is 49, and 128 for unrelated texts).
NEAR_RADIUS, NEAR_SHINGLE, WIDE, WIDE_LIMIT = 7, 5, 256, 44
#: Members of a lowest group, and groups of a higher one.
FAN = 8


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """uint64 fingerprint of each row of a UTF-8 buffer.  bytes.lower and bytes.split know ASCII only, as the contract asks."""
    raw, hash64 = data.tobytes(), xxhash.xxh64_intdigest
    out = np.zeros(len(offsets) - 1, np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        words = raw[a:b].lower().split()
        if not words:
            continue
        text = b" ".join(words)
        if len(words) <= shingle:
            out[i] = hash64(text, SEED)
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-shingle]]).tolist()
        h = np.array([hash64(text[s:e], SEED) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64)
        ones = np.zeros(64, np.int64)
        for j in range(0, len(h), 4096):
            ones += np.unpackbits(h[j : j + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = weights[2 * ones > len(h)].sum(dtype=np.uint64)
    return out


def fingerprint_documents(documents: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """``key`` and ``fp`` (signed 64-bit) of every row; no shuffle."""
    kind = T.StructType([T.StructField("k", documents.schema[key].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(fingerprints(*buffers(b.column("t")), shingle).view(np.int64))], names=["k", "fp"])

    return documents.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, kind).withColumnRenamed("k", key)


def signatures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For near-duplicates: uint64 fingerprints over distinct words, and (n, ``WIDE`` / 64) uint64 signatures over five-word shingles."""
    raw, hash64, hash128 = data.tobytes(), xxhash.xxh64_intdigest, xxhash.xxh3_128_digest
    n = len(offsets) - 1
    fp, wide = np.zeros(n, np.uint64), np.zeros((n, WIDE // 64), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        words = raw[a:b].lower().split()
        if not words:
            continue
        own = list(set(words))
        ones = np.zeros(64, np.int64)
        for j in range(0, len(own), 4096):
            h = np.array([hash64(w, SEED) for w in own[j : j + 4096]], np.uint64)
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        fp[i] = weights[2 * ones > len(own)].sum(dtype=np.uint64)
        many = max(1, len(words) - NEAR_SHINGLE + 1)
        ones = np.zeros(WIDE, np.int64)
        for j in range(0, many, 4096):
            grams = [b" ".join(words[k : k + NEAR_SHINGLE]) for k in range(j, min(many, j + 4096))]
            h = np.frombuffer(b"".join(hash128(g, k) for g in grams for k in range(WIDE // 128)), np.uint8)
            ones += np.unpackbits(h.reshape(len(grams), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        wide[i] = np.packbits(2 * ones > many, bitorder="little").view(np.uint64)
    return fp, wide


def sign_documents(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``node`` (hash of both signatures), ``fp`` and ``wide`` (binary) of every row; no shuffle."""
    kind = T.StructType([T.StructField("k", documents.schema[key].dataType), T.StructField("fp", T.LongType()), T.StructField("wide", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            fp, wide = signatures(*buffers(b.column("t")))
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(fp.view(np.int64)), pa.array([w.tobytes() for w in wide], pa.binary())], names=["k", "fp", "wide"])

    out = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, kind)
    return out.select(F.col("k").alias(key), F.xxhash64("fp", "wide").alias("node"), "fp", "wide")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each 64-bit code in Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels (smallest member) after adding links a-b."""
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


class Index:
    """The tree over fingerprints sorted by (group, Gray rank)."""

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        self.n = len(fp)
        self.levels: list[tuple[np.ndarray, ...]] = []  # from the leaves up: first leaf, leaf end, first child, child end, shared bits, their pattern
        lo = np.arange(self.n)
        hi, own, ones, zeros = lo + 1, group, fp, ~fp
        self.levels.append((lo, hi, lo, hi, np.full(self.n, ~np.uint64(0)), fp))
        while True:
            first = np.append(True, own[1:] != own[:-1]) if len(own) else np.zeros(0, bool)
            at = np.flatnonzero(first)
            if len(at) == len(own):  # one root a group
                break
            rank = np.arange(len(own)) - np.repeat(at, np.diff(np.append(at, len(own))))
            start = np.flatnonzero(rank % FAN == 0)
            end = np.append(start[1:], len(own))
            ones, zeros = np.bitwise_and.reduceat(ones, start), np.bitwise_and.reduceat(zeros, start)
            lo, hi, own = lo[start], hi[end - 1], own[start]
            self.levels.append((lo, hi, start, end, ones | zeros, ones))
        self.root = np.repeat(np.arange(len(lo)), hi - lo)  # of each leaf

    def components(self, fp: np.ndarray, radius: int = RADIUS, wide: np.ndarray | None = None) -> np.ndarray:
        """Component label (smallest position) of each leaf under links of at most ``radius`` bits, which the wide signatures, if given, confirm."""
        label = np.arange(self.n)
        top = len(self.levels) - 1
        reach = np.cumsum((self.levels[top][1] - self.levels[top][0])[self.root]) if self.n else np.zeros(0)
        q0 = 0
        while q0 < self.n:
            q1 = max(q0 + 1, int(np.searchsorted(reach, (reach[q0 - 1] if q0 else 0) + FRONTIER, side="right")))
            links_a: list[np.ndarray] = []
            links_b: list[np.ndarray] = []
            same = []  # by level: the component that all leaves of a node share, or -1
            for lo, hi, *_ in self.levels:
                least, most = np.minimum.reduceat(label, lo), np.maximum.reduceat(label, lo)
                last = np.maximum.reduceat(np.arange(self.n), lo) + 1
                same.append(np.where((least == most) & (last == hi), least, -1))
            q = np.arange(q0, q1)
            node = self.root[q0:q1]
            known = np.zeros(len(node), np.uint64)  # bits that the parent has accounted for
            acc = np.zeros(len(node), np.int64)
            for k in range(top, -1, -1):
                lo, hi, first, end, mask, pattern = self.levels[k]
                keep = (hi[node] > q + 1) & (same[k][node] != label[q])
                q, node, known, acc = q[keep], node[keep], known[keep], acc[keep]
                acc = acc + np.bitwise_count((fp[q] ^ pattern[node]) & mask[node] & ~known)
                known = mask[node]
                keep = acc <= radius
                q, node, known, acc = q[keep], node[keep], known[keep], acc[keep]
                whole = acc + 64 - np.bitwise_count(known) <= radius
                if wide is not None and k:
                    whole[:] = False  # only leaves can be confirmed
                elif wide is not None:
                    sure = np.bitwise_count(wide[q] ^ wide[lo[node]]).sum(axis=1, dtype=np.int64) <= WIDE_LIMIT
                    q, node, known, acc, whole = q[sure], node[sure], known[sure], acc[sure], whole[sure]
                if whole.any():  # every member of the group is near enough
                    links_a.append(q[whole])
                    links_b.append(lo[node[whole]])
                    if k:
                        own = np.unique(node[whole])
                        size = hi[own] - lo[own]
                        begin = np.repeat(lo[own], size)
                        links_a.append(begin)
                        links_b.append(begin + np.arange(len(begin)) - np.repeat(np.cumsum(size) - size, size))
                    q, node, known, acc = q[~whole], node[~whole], known[~whole], acc[~whole]
                if k:
                    size = end[node] - first[node]
                    base = np.repeat(first[node], size)
                    step = np.arange(len(base)) - np.repeat(np.cumsum(size) - size, size)
                    q, known, acc = np.repeat(q, size), np.repeat(known, size), np.repeat(acc, size)
                    node = base + step
            if links_a:
                label = _joined(label, np.concatenate(links_a), np.concatenate(links_b))
            q0 = q1
        return label


def group_links(group: np.ndarray, fp: np.ndarray, radius: int = RADIUS, node: np.ndarray | None = None, wide: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, representative of its component) within each group of rows; a row's node is its fingerprint unless given."""
    node = fp if node is None else node
    order = np.lexsort((gray_rank(fp), group))
    group, fp, node = group[order], fp[order], node[order]
    label = Index(group, fp).components(fp, radius, None if wide is None else wide[order])
    own = np.flatnonzero(label != np.arange(len(label)))
    return node[own], node[label[own]]


#: Fingerprints that a bucket holds on average at most, before a key joins another block.
BUCKET_MEAN = 2048


def blocks(distinct: int, radius: int = RADIUS) -> tuple[int, int]:
    """(blocks, blocks that a key joins): radius + joined blocks, so that some key survives any ``radius`` changes.  More fingerprints get longer keys, so that buckets stay small; the links found are the same."""
    joined = next((j for j in (1, 2, 3) if distinct <= BUCKET_MEAN * 2.0 ** (64 * j / (radius + j))), 4)
    return radius + joined, joined


def _keys(fp: Column, n: int, joined: int) -> Column:
    """Array of bucket keys of a fingerprint, one for each combination of blocks."""
    edge = [64 * i // n for i in range(n + 1)]
    out = []
    for which in combinations(range(n), joined):
        mask = sum(((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in which)
        mask -= (mask >> 63) << 64
        out.append(F.xxhash64(fp.bitwiseAND(F.lit(mask)), F.lit(len(out))))
    return F.array(*out)


def link_fingerprints(distinct: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Links (a, b), a > b, between distinct fingerprints ``fp``; their components are those of all pairs within ``radius``.

    With columns ``node`` and ``wide`` links are between nodes, and those of confirmed pairs only.
    """
    total = distinct.count()
    n, joined = blocks(total, radius)
    sure = "wide" in distinct.columns
    columns = ["fp", "node", "wide"] if sure else ["fp"]
    keyed = distinct.select(*columns, F.explode(_keys(F.col("fp"), n, joined)).alias("key"))
    size = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key", "m", F.col("m").alias("rows"))
    units = hot_join(keyed, size, "key", "rows", total * math.comb(n, joined), hot_rows)
    chunks = F.ceil(F.col("m") / bucket_rows).cast("int")
    mine = F.pmod(F.xxhash64(columns[-1], F.lit(7)), chunks).cast("int")
    units = (
        units.withColumn("c", chunks).withColumn("i", mine)
        # with one chunk a unit is the bucket; else a chunk meets every other one
        .withColumn("j", F.explode(F.when(F.col("c") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("c") - 1), lambda j: j != F.col("i")))))
        .select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("unit"), *columns)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(held: list[np.ndarray]) -> pa.RecordBatch:
            unit, fp, *more = held
            a, b = group_links(unit, fp.view(np.uint64), radius, *(x.view(np.uint64) if x.ndim > 1 else x for x in more))
            a, b = a.view(np.int64), b.view(np.int64)
            pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(c).to_numpy() for c in ("unit", "fp", "node")[: 3 if sure else 2]]
            if sure:
                own.append(np.frombuffer(b"".join(batch.column("wide").to_pylist()), np.uint64).reshape(batch.num_rows, -1))
            held = [np.concatenate(x) for x in zip(held, own, strict=True)] if held else own
            if len(held[0]) >= UNIT_ROWS:
                at = int(np.searchsorted(held[0], held[0][-1]))  # units come sorted; the last may go on
                if at:
                    yield links([x[:at] for x in held])
                    held = [x[at:] for x in held]
        if held:
            yield links(held)

    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "a bigint, b bigint").distinct()


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the links (a, b) of all batches."""
    held = [np.stack([b.column(c).to_numpy() for c in ("a", "b")]) for b in batches if b.num_rows]
    if not held:
        return
    node, at = np.unique(np.concatenate(held, axis=1), return_inverse=True)
    a, b = at.reshape(2, -1)
    root = node[_joined(np.arange(len(node)), a, b)]
    for i in range(0, len(node), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in (node, root)], names=["node", "root"])


def components(links: DataFrame, rounds: int = 60, hot_rows: int = HOT_ROWS, task_links: int = TASK_LINKS) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b), root the smallest of its component.

    Up to ``task_links`` links are closed in one task.  More take alternating large and
    small stars: each round re-hangs neighbours on their smallest common neighbour, by joins
    with grouped minima; the number of rounds grows with the logarithm of the longest chain.
    Each round is written to the shared folder.  A hub's neighbours, which may be most nodes,
    are not shuffled to it.  Every round is some ten exchanges, whose stages the driver keeps track of.
    """
    edges = settle(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    total, state = edges.count(), None
    if total <= task_links:
        return edges.coalesce(1).mapInArrow(_closed, "node bigint, root bigint")
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = hot_join(both.where("b > a"), least, "a", "n", 2 * total, hot_rows).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = hot_join(large, least, "a", "n", 2 * total, hot_rows)
        edges = settle(
            small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
            .where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        total, state = now[0], now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _grouped(documents: DataFrame, text: str, key: str, radius: int, shingle: int | None, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(``key``, ``node``) of every row; (``node``, ``root``, ``component_id``, ``n``) of every node, root the smallest of its component and n its number of rows.

    A node is a fingerprint over shingles or, without ``shingle``, the pair of signatures of near-duplicates.
    """
    if shingle:
        prints = cut(fingerprint_documents(documents, text, key, shingle).withColumnRenamed("fp", "node"))
        own = cut(prints.groupBy("node").agg(F.min(key).alias("least"), F.count("*").alias("n")))
        links = link_fingerprints(own.select(F.col("node").alias("fp")), radius, hot_rows=hot_rows)
    else:
        prints = cut(sign_documents(documents, text, key))
        own = cut(prints.groupBy("node").agg(F.min(key).alias("least"), F.first("fp").alias("fp"), F.first("wide").alias("wide"), F.count("*").alias("n")))
        links = link_fingerprints(own.select("node", "fp", "wide"), radius, hot_rows=hot_rows)
    root = components(links, hot_rows=hot_rows).withColumnRenamed("node", "linked")
    linked = own.join(root, own.node == root.linked)
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    linked = hot_join(linked.select("node", "root"), smallest, "root", "members", own.count(), hot_rows).select("node", "root", "component_id")
    each = own.join(linked, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.coalesce("component_id", "least").alias("component_id"), "n")
    return prints.select(key, "node"), cut(each)


def near_duplicates(documents: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS, shingle: int = SHINGLE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``key``, ``fp`` and ``component_id`` (smallest key of the component) of every row."""
    prints, each = _grouped(documents, text, key, radius, shingle, hot_rows)
    return hot_join(prints, each.drop("root"), "node", "n", prints.count(), hot_rows).select(key, F.col("node").alias("fp"), "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_query(documents: DataFrame) -> DataFrame:
    """``op8``."""
    out = near_duplicates(documents)
    return out.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, text: str = "text", key: str = "doc_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """The documents without near-duplicates: one row of each component stays, that with the smallest id.

    Of several rows of a component with that id the one with the smallest text stays, whatever rows of other
    components have the id too.  A row with a null id stays only if its whole component has no id.
    """
    prints, each = _grouped(documents, text, key, NEAR_RADIUS, None, hot_rows)
    first = F.col(key).eqNullSafe(F.col("component_id"))
    found = hot_join(prints, each, "node", "n", prints.count(), hot_rows).groupBy(key).agg(F.count("*").alias("rows"), F.max(first).alias("first"))
    ids = cut(found.where("first"))
    alone = ids.where((F.col("rows") == 1) & F.col(key).isNotNull()).select(key)
    kept = documents.join(alone, key, "left_semi").select(*documents.columns)
    # ids of several rows, and the null id, do not tell the rows apart: these are decided by their signatures
    many = ids.where((F.col("rows") > 1) | F.col(key).isNull()).select(F.col(key).alias("id"))
    if many.limit(1).count():
        rows = documents.join(many, F.col(key).eqNullSafe(F.col("id")), "left_semi").select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("r"), F.col(text).alias("t"))
        rows = sign_documents(rows, "t", "r").join(each.drop("n"), "node").where(F.col("r")[key].eqNullSafe(F.col("component_id")))
        one = rows.groupBy("root").agg(F.min_by("r", F.struct(F.col("r")[text])).alias("r"))
        kept = kept.unionByName(one.select("r.*"))
    return kept
