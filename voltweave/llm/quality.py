"""Quality classifier: Bradley-Terry ranking from preference pairs.

Every document gets a vector of text statistics.  Preference pairs (a document
marked good over one marked bad) are drawn from a bounded sample of labelled
rows; logistic loss on the feature differences of the pairs gives a weight
vector, and the score of a document is its inner product with it.  The cut
between good and bad is a quantile of the training scores, the share of bad
documents in the sample; scores are mapped to 0..1 so that the cut is at
``THRESHOLD``.

Edge cases: a null text counts as empty and is scored like an empty one; rows
with a null id are scored and have a null ``held_out``; without labels of both
kinds every score is ``THRESHOLD``; repeated rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, buffers, fold, slices

THRESHOLD = 0.7
#: Bound of the labelled rows per class that are fitted on.
MAX_LABELLED = 6000
#: Preference pairs drawn for the fit.
N_PAIRS = 60_000


def _classes() -> np.ndarray:
    """256 x K indicator matrix of byte classes."""
    b = np.arange(256)
    up, low, dig = (b >= 65) & (b <= 90), (b >= 97) & (b <= 122), (b >= 48) & (b <= 57)
    white, stop = np.isin(b, [9, 10, 11, 12, 13, 32]), np.isin(b, list(b".,;:?'\"()-"))
    symbol = (b > 32) & (b < 127) & ~up & ~low & ~dig & ~stop
    return np.stack([up, low, dig, white, b == 10, stop, b == 33, b == 124, symbol, b >= 128, b == 46], axis=1).astype(np.float64)


_CLASSES = _classes()


def features(data: np.ndarray, offsets: np.ndarray, packer: zstandard.ZstdCompressor | None = None) -> np.ndarray:
    """A row of statistics for each document of a UTF-8 buffer."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n, dtype=np.int64), size)
    hist = np.bincount(row * 256 + data, minlength=n * 256).reshape(n, 256).astype(np.float64)
    up, low, dig, white, lines, stop, bang, bar, symbol, high, dot = (hist @ _CLASSES).T
    gap = _CLASSES[:, 3].astype(bool)[data]
    starts = ~gap
    starts[1:] &= gap[:-1]
    begins = offsets[:-1][size > 0]
    starts[begins] = ~gap[begins]
    words = np.bincount(row[starts], minlength=n).astype(np.float64)
    packer = packer or zstandard.ZstdCompressor(level=1)
    raw = data.tobytes()
    packed = np.array([len(packer.compress(raw[a:b])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], dtype=np.float64)
    nb, letters, w = np.maximum(size, 1.0), np.maximum(up + low + high, 1.0), np.maximum(words, 1.0)
    share = lambda x, of: np.log((x + 0.05) / (of + 5.0))
    ratio = packed / nb
    depth = np.log(nb)
    return np.stack(
        [
            share(up, letters), up / letters, share(symbol, nb), symbol / nb, share(bang, w), share(bar, w), share(dig, nb),
            share(stop, w), share(dot, w), letters / w, share(lines, nb), ratio, np.log(ratio), np.log(ratio) * depth, depth,
            depth**2, high / letters, hist.max(axis=1) / nb, (words < 4).astype(np.float64),
        ],
        axis=1,
    )


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float
    slope: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """0..1; ``THRESHOLD`` at the cut."""
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weight
        shift = np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(self.slope * (z - self.cut) + shift, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, n_pairs: int = N_PAIRS, ridge: float = 1e-3, seed: int = 5) -> Model:
    """Bradley-Terry weights by Newton steps on the pairwise logistic loss."""
    k = x.shape[1]
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model(np.zeros(k), np.ones(k), np.zeros(k), 0.0, 1.0)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.clip((x - mean) / scale, -6, 6)
    pick = np.random.default_rng(seed)
    d = z[pick.choice(good, n_pairs)] - z[pick.choice(bad, n_pairs)]
    w = np.zeros(k)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
        grad = d.T @ (p - 1) / n_pairs + ridge * w
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / n_pairs + ridge * np.eye(k), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    at = float(np.quantile(s, len(bad) / len(y)))
    return Model(mean, scale, w, at, 1.0)


def _feature_batches(keep: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for b in slices(batches, text):
            x = features(*buffers(b.column(text)), packer)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), flat], names=[*keep, "x"])

    return run


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = MAX_LABELLED, text: str = "text", key: str = "doc_id") -> Model:
    """Fit on a bounded sample of labelled rows: at most about ``per_class`` ids of each label value are looked up."""
    some = bounded_sample(labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")), "y", "k", per_class)
    # the sample is bounded by per_class ids of two classes, so it may be broadcast
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(some), "k").select("k", "y", "t")
    got = rows.mapInArrow(_feature_batches(["k", "y"], "t"), f"k {rows.schema['k'].dataType.simpleString()}, y int, x array<double>").toPandas().sort_values(["k", "y"])
    x = np.stack(got["x"].to_list()) if len(got) else np.zeros((0, _width()))
    return fit(x, got["y"].to_numpy())


def _width() -> int:
    return features(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]


def score_documents(documents: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``score`` and ``predicted`` of every row, from its whole text; no shuffle."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for b in slices(batches, "t"):
            s = model.score(features(*buffers(b.column("t")), packer))
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["k", "score", "predicted"])

    out = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, score double, predicted int")
    return out.withColumnRenamed("k", key)


def quality_query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``op1``: labels are learned only from ids whose fold of 4 is not 2."""
    model = train(documents, labels.where(fold(F.col("doc_id"), 4) != 2))
    out = score_documents(documents, model)
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
