"""Shared helpers: table access, folds, bounded samples, checkpoints, Arrow buffers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text a Python worker handles at once; an Arrow batch above it is cut into slices.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo ``k``.  A null id has a null fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def shared_folder(df: DataFrame) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    Where the setting is absent a local session gets a temporary folder; on a cluster, whose machines do not
    share one, a RuntimeError says what to set.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="vw-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the shared folder."""
    shared_folder(df)
    return df.checkpoint(eager=True)


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage in a loop: written to the shared folder as Parquet and read back.

    A checkpoint keeps the size estimate of its plan, which every join of every round multiplies
    up; the files have a size of their own.
    """
    path = f"{shared_folder(df)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a key from which ``hot_join`` keeps it out of the shuffle, and such keys at most.
HOT_ROWS, HOT_KEYS = 1 << 18, 1 << 16


def hot_join(rows: DataFrame, side: DataFrame, key: str, n: str, total: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of ``rows`` with ``side``, which has each key once and in ``n`` the number of its rows; ``n`` is dropped.

    Rows of a frequent key stay where they are and meet a broadcast of the frequent part of ``side``, so that no key
    gathers in one task.  ``total`` rows have at most ``HOT_KEYS`` keys of more than their ``HOT_KEYS``-th part,
    so the broadcast does not grow with the input.  Up to ``hot_rows`` rows can have no such key; they take
    a plain join, which costs the driver far fewer stages.  Null keys join nothing.
    """
    if total <= hot_rows:
        return rows.join(side.drop(n), key)
    least = max(hot_rows, total // HOT_KEYS)
    often = side.where(F.col(n) > least).drop(n)
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(side.where(F.col(n) <= least).drop(n), key)
    return rows.join(F.broadcast(often), key).unionByName(rest)


def class_counts(df: DataFrame, label: str, key: str) -> dict:
    """Rows of every label; reads the label and key columns only."""
    rows = (
        df.where(F.col(label).isNotNull() & F.col(key).isNotNull())
        .groupBy(label).agg(F.count("*").alias("n")).collect()
    )
    return {r[label]: r["n"] for r in rows}


def bounded_sample(df: DataFrame, label: str, key: str, per_class: int, seed: int = 17, counts: dict | None = None) -> DataFrame:
    """About ``per_class`` rows of each label value, chosen by a hash of ``key``.

    The share kept is set from exact label counts, so the expected size is at most
    ``per_class`` for each label, whatever the input size; no label is left out.
    Null labels and null keys are left out.
    """
    counts = class_counts(df, label, key) if counts is None else counts
    if not counts:
        return df.where(F.lit(False))
    span = 1 << 30
    share = {value: min(span, int(span * per_class / n) + 1) for value, n in counts.items()}
    keep = F.try_element_at(F.create_map(*(F.lit(x) for pair in share.items() for x in pair)), F.col(label))
    return df.where((F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(span)) < keep) & F.col(label).isNotNull() & F.col(key).isNotNull())


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, none with more than ``limit`` bytes in ``column`` unless it is a single row."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        start = 0
        while start < b.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield b.slice(start, stop - start)
            start = stop


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]
