"""Toxicity by compression distance.

A bounded labelled sample is dealt into two thirds for dictionaries and one third
for calibration.  The ordinary zstandard dictionary (raw content) is cut from
ordinary texts, equal shares of each.  The toxic one is cut from toxic texts by a
contrasting form of dictionary training: byte grams whose document frequency in
toxic texts stands out against ordinary ones (signed likelihood ratio) mark
segments of the toxic texts; the segment with the greatest sum of grams not yet
covered is taken, again and again, and the strongest comes last.  Behind them stands
the ordinary content, so that lengths under the two dictionaries differ where
toxic wording occurs and hardly elsewhere.

The whole text is cut into short windows at white space.  The gain of a window is
how many bytes fewer the toxic dictionary makes of it.  Numbers and densities of
windows at several gains, and the largest gain, give a score by a logistic
calibration on the third of the sample that no dictionary was cut from.

Edge cases: null counts as empty, an empty text has score 0; without labels of
both kinds every score is 0; repeated rows are scored one by one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, buffers, fold, slices
from .langid import mix
from .zdict import Coder, windows

THRESHOLD = 0.5
#: Bound of the labelled texts per class, and of the characters of each that are learned from (a stretch from the middle).
MAX_LABELLED, MAX_CHARS = 2500, 16_000
#: Bytes of ordinary content, and of toxic segments, in a dictionary.
ORDINARY_BYTES, TOXIC_BYTES = 48 << 10, 8 << 10
#: Bytes of a gram, and least likelihood ratio statistic of one that marks a toxic segment (chance: about one in a million).
GRAM, LEAST_RATIO = 4, 24.0
#: Bytes of a window, and gains that its hits are counted at.
WINDOW, GAINS = 64, (2, 4, 6)


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weight: tuple[float, ...] = (0.0,) * (2 * len(GAINS) + 1)
    bias: float = -40.0

    def coders(self) -> tuple[Coder, Coder]:
        return Coder(self.ordinary), Coder(self.toxic)


def _grams(text: bytes) -> np.ndarray:
    """Code of the gram at each place of a text."""
    raw = np.frombuffer(text, np.uint8).astype(np.int64)
    n = max(0, len(raw) - GRAM + 1)
    return sum((raw[i : i + n] << (8 * i) for i in range(GRAM)), np.zeros(n, np.int64))


def _document_frequency(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate([np.zeros(0, np.int64), *(np.unique(_grams(t)) for t in texts)]), return_counts=True)


def contrast(toxic: list[bytes], ordinary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted grams that toxic texts hold significantly more often, and their likelihood ratio statistics."""
    gram, a = _document_frequency(toxic)
    other, count = _document_frequency(ordinary)
    b = np.zeros(len(gram))
    at = np.searchsorted(other, gram)
    same = np.append(other, -1)[at] == gram
    b[same] = count[at[same]]
    na, nb = len(toxic), len(ordinary)
    k, n = a + b, na + nb
    part = lambda x, e: np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(e, 1e-9)), 0.0)
    ratio = 2 * (part(a, na * k / n) + part(b, nb * k / n) + part(na - a, na * (n - k) / n) + part(nb - b, nb * (n - k) / n))
    keep = (ratio >= LEAST_RATIO) & (a * nb > b * na)
    return gram[keep], ratio[keep]


def segments(toxic: list[bytes], gram: np.ndarray, ratio: np.ndarray, size: int) -> bytes:
    """Dictionary content of at most ``size`` bytes: segments of toxic texts, the strongest last.

    A segment is a run of the text in which marked grams follow each other with no gap.  Grams of a taken
    segment count no more for the others.
    """
    worth = dict(zip(gram.tolist(), ratio.tolist(), strict=True))
    found: dict[bytes, list[int]] = {}
    for text in toxic:
        codes = _grams(text)
        at = np.flatnonzero(np.isin(codes, gram))
        if len(at):
            first = np.flatnonzero(np.append(True, np.diff(at) > GRAM))
            for i, j in zip(at[first].tolist(), at[np.append(first[1:], len(at)) - 1].tolist(), strict=True):
                found.setdefault(text[i : j + GRAM], sorted(set(codes[i : j + 1].tolist()) & worth.keys()))
    queue = [(-round(sum(worth[g] for g in own), 6), segment) for segment, own in found.items()]
    heapq.heapify(queue)
    best: list[bytes] = []
    used = 0
    while queue:
        was, segment = heapq.heappop(queue)
        now = -round(sum(worth.get(g, 0.0) for g in found[segment]), 6)
        if now > was and queue and now > queue[0][0]:
            if now < 0:
                heapq.heappush(queue, (now, segment))
            continue
        used += len(segment) + 1
        if now == 0 or used > size:
            break
        best.append(segment)
        for g in found[segment]:
            worth.pop(g, None)
    return b"".join(b" " + x for x in reversed(best)) + b" " * bool(best)


def gains(coders: tuple[Coder, Coder], data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each window, and bytes that the toxic dictionary saves over the ordinary one."""
    row, start, end = windows(data, offsets, WINDOW)
    folded = data.copy()
    folded[(folded >= 65) & (folded <= 90)] += 32
    raw = folded.tobytes()
    return row, coders[0].lengths(raw, start, end) - coders[1].lengths(raw, start, end)


def statistics(row: np.ndarray, gain: np.ndarray, n: int) -> np.ndarray:
    """Per text: for each of ``GAINS`` the log of hits + 1 and the log density of hits; the largest gain."""
    k = np.bincount(row, minlength=n)
    out = []
    for least in GAINS:
        hits = np.bincount(row, weights=gain >= least, minlength=n)
        out += [np.log1p(hits), np.log((hits + 0.02) / (k + 1.0))]
    top = np.zeros(n)
    np.maximum.at(top, row, gain)
    return np.stack([*out, np.clip(top, 0, 16) / 8], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    z = np.column_stack([x, np.ones(len(x))])
    each = np.where(y == 1, 0.5 / max((y == 1).mean(), 1e-9), 0.5 / max((y == 0).mean(), 1e-9))
    each = np.sqrt(each)  # between balanced and plain counts
    each /= each.mean()
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (each * p * (1 - p))[:, None]).T @ z / len(z) + ridge * np.eye(z.shape[1]), z.T @ (each * (p - y)) / len(z) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _one_of_copies(texts: list[str], y: np.ndarray) -> np.ndarray:
    """Rows to fit on: one of those of a class that share their smallest four-word shingle hash, so that copies of a text do not make its words typical of its class."""
    seen: set[tuple[int, int]] = set()
    keep = []
    for i, t in enumerate(texts):
        w = t.lower().split()
        key = (int(y[i]), min((xxhash.xxh64_intdigest(" ".join(w[j : j + 4])) for j in range(max(1, len(w) - 3))), default=0))
        if key not in seen:
            seen.add(key)
            keep.append(i)
    return np.array(keep, np.int64)


def fit(texts: list[str], y: np.ndarray) -> Model:
    """Two of three rows of each class give the dictionaries, the third the calibration; copies are left out."""
    own = _one_of_copies(texts, y)
    y = y[own]
    rank = np.zeros(len(y), np.int64)
    for c in (0, 1):
        rank[y == c] = np.arange((y == c).sum())
    low = [texts[i].lower().encode() for i in own]
    cut = rank % 3 != 2
    toxic, plain = [t for t, c, d in zip(low, y, cut, strict=True) if c and d], [t for t, c, d in zip(low, y, cut, strict=True) if not c and d]
    held = [t for t, d in zip(low, cut, strict=True) if not d]
    if not toxic or not plain or not held:
        return Model(b"", b"")
    ordinary = mix([t.decode() for t in plain], ORDINARY_BYTES)
    model = Model(ordinary, segments(toxic, *contrast(toxic, plain), TOXIC_BYTES) + ordinary)
    data, offsets = np.frombuffer(b"".join(held), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in held])])
    w = _logistic(statistics(*gains(model.coders(), data, offsets), len(held)), y[~cut])
    model.weight, model.bias = tuple(w[:-1]), float(w[-1])
    return model


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = MAX_LABELLED, text: str = "text", key: str = "doc_id") -> Model:
    some = bounded_sample(labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")), "y", "k", per_class)
    # the sample is bounded by per_class ids of two classes, so it may be broadcast; its texts are bounded by MAX_CHARS
    middle = F.substring(F.col(text), F.greatest(F.lit(1), F.floor((F.length(text) - MAX_CHARS) / 2)).cast("int"), F.lit(MAX_CHARS))
    rows = documents.select(F.col(key).alias("k"), middle.alias("t")).where(F.col("t").isNotNull()).join(F.broadcast(some), "k").collect()
    got = sorted((r.k, r.y, r.t) for r in rows)
    return fit([g[2] for g in got], np.array([g[1] for g in got]))


def score_documents(documents: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``score``, ``predicted`` and ``hits`` (windows with a gain) of every row; no shuffle."""
    kind = documents.schema[key].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        coders = m.coders()
        for b in slices(batches, "t"):
            n = b.num_rows
            data, offsets = buffers(b.column("t"))
            row, gain = gains(coders, data, offsets)
            s = statistics(row, gain, n) @ np.array(m.weight) + m.bias
            p = np.where(np.diff(offsets) > 0, 1 / (1 + np.exp(-np.clip(s, -40, 40))), 0.0)
            hits = np.bincount(row, weights=gain >= GAINS[0], minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32)), pa.array(hits)], names=["k", "score", "predicted", "hits"])

    out = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, score double, predicted int, hits bigint")
    return out.withColumnRenamed("k", key)


def toxicity_query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``op9``: labels are learned only from ids whose fold of 5 is not 0."""
    model = train(documents, labels.where(fold(F.col("doc_id"), 5) != 0))
    out = score_documents(documents, model)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "hits")
