"""Language identification by compression.

Every language gets a raw-content zstandard dictionary cut from a bounded sample
of its documents; where there are very many, the dictionaries are smaller.  A text is split into windows that end at white space, every
window of the whole text is compressed under every dictionary, and the language
with the smallest total wins.  Dictionaries and texts are lower-cased.  The
margin is the relative gap between the best and the second total.  Texts without
a letter are rejected, and those with a narrow margin.  The least margin grows with the
evidence, ``min_margin * (1 - EVIDENCE / bytes)``: next to nothing is asked of a few
words, for which one byte is a wide margin, and ``min_margin`` of long texts.

Edge cases: null, empty and letterless texts are ``und`` with score 0; ties go
to the more frequent language, then to the one that sorts first; without any
labelled text everything is ``und``; repeated rows are classified one by one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, buffers, class_counts, fold, slices
from .zdict import Coder, windows

UNKNOWN = "und"
#: Documents of each language that a dictionary is cut from (bound of the sample).
DOCS_PER_LANG = 150
#: Bytes of a dictionary.
DICT_BYTES = 96 << 10
#: Bytes of all dictionaries; above about 680 languages each of them is shorter for it, but none under the last.
ALL_BYTES, LEAST_BYTES = 64 << 20, 1 << 10
#: Dictionaries that a worker keeps ready (about 1 MB each); of more languages it makes one ready at a time.
READY = 64
#: Bytes of a window.
WINDOW = 1024
#: Least margin of long texts, and bytes of text up to which even a tie says nothing.
MIN_MARGIN, EVIDENCE = 0.003, 200


@dataclass
class Model:
    langs: list[str]
    dicts: list[bytes]
    window: int = WINDOW

    def coders(self) -> Iterable[Coder]:
        """Can be gone over again and again."""
        return [Coder(d) for d in self.dicts] if len(self.dicts) <= READY else _InTurn(self.dicts)


@dataclass
class _InTurn:
    dicts: list[bytes]

    def __iter__(self) -> Iterator[Coder]:
        return map(Coder, self.dicts)


def mix(texts: list[str], size: int) -> bytes:
    """Dictionary content of at most ``size`` bytes: equal shares of distinct texts, spread over each text."""
    own = [t.encode() for t in dict.fromkeys(texts) if t]
    out: list[bytes] = []
    left = size
    for i, t in enumerate(sorted(own, key=len)):
        share = left // (len(own) - i)
        if len(t) > share:  # a stretch from the middle, as good as any other
            at = (len(t) - share) // 2
            t = t[at : at + share]
        out.append(t)
        left -= len(t)
    return b"\n".join(out)[:size]


def train(documents: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", docs_per_lang: int = DOCS_PER_LANG, dict_bytes: int = DICT_BYTES) -> Model:
    """Dictionaries of all languages from a bounded sample of each; they are cut where the sample is, so that only they come to the driver."""
    # no dictionary takes more of a text than its own size, from the middle: so much of it is enough, and bounds what a task holds
    middle = F.substring(F.col(text), F.greatest(F.lit(1), F.floor((F.length(text) - dict_bytes) / 2)).cast("int"), F.lit(dict_bytes))
    rows = documents.select(F.col(key).alias("k"), F.col(lang).alias("lang"), middle.alias("t")).where(F.col("t").rlike(r"\p{L}"))
    counts = class_counts(documents.select(F.col(lang).alias("lang"), F.col(key).alias("k")), "lang", "k")
    size = max(min(dict_bytes, LEAST_BYTES), min(dict_bytes, ALL_BYTES // max(1, len(counts))))

    def cut_one(own: pa.Table) -> pa.Table:
        got = sorted(zip(own.column("k").to_pylist(), own.column("t").to_pylist(), strict=True))
        return pa.table({"lang": own.column("lang").slice(0, 1).cast(pa.string()), "d": pa.array([mix([t.lower() for _, t in got], size)], pa.binary())})

    made = bounded_sample(rows, "lang", "k", docs_per_lang, counts=counts).groupBy("lang").applyInArrow(cut_one, "lang string, d binary").collect()
    dicts = {r.lang: bytes(r.d) for r in made if r.lang != UNKNOWN}
    langs = sorted(dicts, key=lambda x: (-counts[x], x))  # ties go to the first
    return Model(langs, [dicts[name] for name in langs])


def totals(model: Model, coders: Iterable[Coder], data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Compressed bytes of each row, under one dictionary after the other."""
    row, start, end = windows(data, offsets, model.window)
    raw = data.tobytes()
    n = len(offsets) - 1
    return (np.bincount(row, weights=c.lengths(raw, start, end), minlength=n) for c in coders)


def predict(model: Model, coders: Iterable[Coder], column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Best language, score and margin of each text."""
    n = len(column)
    letters = pc.fill_null(pc.match_substring_regex(column, r"\pL"), False).to_numpy(zero_copy_only=False)
    if not model.dicts:
        return [UNKNOWN] * n, np.zeros(n), np.zeros(n)
    best, least, second = np.zeros(n, np.int64), np.full(n, np.inf), np.full(n, np.inf)
    for i, size in enumerate(totals(model, coders, *buffers(pc.utf8_lower(column)))):
        second = np.minimum(second, np.maximum(least, size))
        best[size < least] = i
        least = np.minimum(least, size)
    margin = (second - least) / np.maximum(second, 1) if len(model.dicts) > 1 else np.ones(n)
    margin = np.where(letters, margin, 0.0)
    score = np.where(letters, 1 / (1 + np.exp(-np.clip(100 * margin, 0, 40))), 0.0)
    return [model.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], score, margin


def _identified(documents: DataFrame, model: Model, text: str, keep: list[str], min_margin: float) -> tuple[DataFrame, list]:
    """Positional columns c0, c1, ... for ``keep`` with ``lang_pred``, ``score``, ``margin`` and ``rejected``; and the columns that name them back."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # about ALL_BYTES at most
    names = [f"c{i}" for i in range(len(keep))]
    frame = documents.select(*(F.col(f"`{c}`").alias(n) for n, c in zip(names, keep, strict=True)), *([] if text in keep else [F.col(f"`{text}`").alias("t")]))
    read = names[keep.index(text)] if text in keep else "t"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        coders = m.coders()
        for b in slices(batches, read):
            lang, score, margin = predict(m, coders, b.column(read))
            size = pc.fill_null(pc.binary_length(b.column(read)), 0).to_numpy(zero_copy_only=False)
            rejected = np.array([x == UNKNOWN for x in lang], bool) | (margin < min_margin * (1 - EVIDENCE / np.maximum(size, 1)))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(lang, pa.string()), pa.array(score), pa.array(margin), pa.array(rejected)], names=[*names, "lang_pred", "score", "margin", "rejected"])

    types = dict(frame.dtypes)
    out = frame.mapInArrow(run, ", ".join([*(f"{n} {types[n]}" for n in names), "lang_pred string, score double, margin double, rejected boolean"]))
    return out, [F.col(n).alias(c) for n, c in zip(names, keep, strict=True)]


def identify(documents: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, min_margin: float = MIN_MARGIN) -> DataFrame:
    """``keep`` columns with ``lang_pred``, ``score``, ``margin`` and ``rejected`` (no letter, or a narrow margin).

    ``lang_pred`` is the best language even of a rejected text with letters.  No shuffle.
    """
    out, back = _identified(documents, model, text, documents.columns if keep is None else keep, min_margin)
    return out.select(*back, "lang_pred", "score", "margin", "rejected")


def accepted(documents: DataFrame, model: Model, text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """The documents whose language is not rejected, with their own columns only, whatever their names."""
    out, back = _identified(documents, model, text, documents.columns, min_margin)
    return out.where(~F.col("rejected")).select(*back)


def language_query(documents: DataFrame) -> DataFrame:
    """``op3``: text and lang are learned only from ids whose fold of 3 is not 1."""
    model = train(documents.where(fold(F.col("doc_id"), 3) != 1))
    out = identify(documents, model, keep=["doc_id"])
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "margin", "rejected")
