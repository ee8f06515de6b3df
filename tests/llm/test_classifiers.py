import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from voltweave.llm import langid, quality, toxicity, zdict

from .data import DOCS, ODD, corpus

LABELS = "doc_id long, quality int, toxic int"


def held(i, k, r):
    return zlib.crc32(str(i).encode()) % k == r


def test_fold_is_crc32_of_the_text(spark):
    from voltweave.llm.common import fold

    got = [r[0] for r in spark.range(50).select(fold(F.col("id"), 4)).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 4 for i in range(50)]


def test_quality_on_held_out_rows(spark):
    rows, labels = corpus()
    docs, lab = spark.createDataFrame(rows + ODD, DOCS), spark.createDataFrame(labels + [(1, None, None), (None, 1, 1)], LABELS)
    got = quality.quality_query(docs, lab).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    want = {i: q for i, q, _ in labels}
    own = [r for r in got if r.held_out and r.doc_id in want]
    assert len(own) > 30 and all(r.held_out == held(r.doc_id, 4, 2) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == want[r.doc_id] for r in own]) > 0.95
    assert next(r for r in got if r.doc_id is None).held_out is None


def test_quality_ignores_held_out_labels_and_other_columns(spark):
    rows, labels = corpus()
    a = quality.quality_query(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))
    wrong = [(i, 1 - q if held(i, 4, 2) else q, t) for i, q, t in labels]
    blank = [(i, t, None, None, None) for i, t, *_ in rows]
    b = quality.quality_query(spark.createDataFrame(blank, DOCS), spark.createDataFrame(wrong, LABELS))
    assert {r.doc_id: r.score for r in a.collect()} == {r.doc_id: r.score for r in b.collect()}


def test_quality_without_labels_or_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    none = spark.createDataFrame([], LABELS)
    assert {round(r.score, 9) for r in quality.quality_query(docs, none).collect()} == {0.7}
    assert quality.quality_query(spark.createDataFrame([], DOCS), none).count() == 0


def test_bradley_terry_orders_pairs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x @ [2.0, -1.0, 0.0] + rng.normal(scale=0.1, size=400) > -0.5).astype(int)
    s = quality.fit(x, y, 20_000).score(x)
    assert np.mean((s >= quality.THRESHOLD) == y) > 0.95 and np.mean(s[y == 1][:, None] > s[y == 0][None, :100]) > 0.98


def test_language_on_held_out_rows(spark):
    rows, _ = corpus()
    got = langid.language_query(spark.createDataFrame(rows + ODD, DOCS)).collect()
    want = {i: lang for i, _, lang, *_ in rows}
    own = [r for r in got if r.held_out and r.doc_id in want]
    assert len(got) == len(rows) + len(ODD) and np.mean([r.lang_pred == want[r.doc_id] for r in own]) > 0.97
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1001, 1002, 1003, 1004))
    assert by[1005].lang_pred != "und" and all(0 <= r.score <= 1 for r in got)


def test_language_rejects_a_narrow_margin_and_keeps_columns(spark):
    rows, _ = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.train(docs)
    odd = docs.withColumn("rejected", F.lit("mine")).withColumn("score", F.lit(5)).withColumn("c0", F.lit(1.5))
    kept = langid.accepted(odd, model)
    assert kept.columns == odd.columns and kept.count() == len(rows) and kept.first()["rejected"] == "mine"
    nothing = spark.createDataFrame([(1, "123", "en", "s", 3), (2, None, "en", "s", 0)], DOCS)
    assert langid.accepted(nothing, model).count() == 0
    twin = langid.Model(["a", "b"], [model.dicts[0], model.dicts[0]])
    assert langid.accepted(docs.where(F.length("text") > 300), twin).count() == 0


def test_every_language_is_learned(spark):
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyzäöüéèñçåøß"
    syllables = {f"l{i:02}": ["".join(rng.choice(letters) for _ in range(3)) for _ in range(10)] for i in range(70)}
    rows = []
    for i, (lang, own) in enumerate(syllables.items()):
        for _ in range(8 if i < 64 else 4):  # the last six are the rarest
            rows.append((len(rows), " ".join(rng.choice(own) + rng.choice(own) for _ in range(60)), lang, "s", 0))
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.train(docs)
    assert sorted(model.langs) == sorted(syllables) and model.langs[-6:] == [f"l{i}" for i in range(64, 70)]
    fresh = [(i, " ".join(rng.choice(own) + rng.choice(own) for _ in range(60)), lang, "s", 0) for i, (lang, own) in enumerate(syllables.items())]
    got = langid.identify(spark.createDataFrame(fresh, DOCS), model).collect()
    assert len(got) == 70 and all(r.lang_pred == r.lang for r in got)


def test_many_languages_get_smaller_dictionaries(spark, monkeypatch):
    rows, _ = corpus()
    monkeypatch.setattr(langid, "ALL_BYTES", 16_000)
    model = langid.train(spark.createDataFrame(rows, DOCS))
    assert len(model.langs) == 4 and all(3000 < len(d) <= 4000 for d in model.dicts)


def test_language_without_training_text(spark):
    got = langid.language_query(spark.createDataFrame([(1, "some text", None, None, 9)], DOCS)).first()
    assert got.lang_pred == "und" and langid.language_query(spark.createDataFrame([], DOCS)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    rows, labels = corpus(400)
    got = toxicity.toxicity_query(spark.createDataFrame(rows + ODD, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    want = {i: t for i, _, t in labels}
    own = [r for r in got if r.held_out and r.doc_id in want]
    assert len(got) == len(rows) + len(ODD) and all(r.held_out == held(r.doc_id, 5, 0) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == want[r.doc_id] for r in own]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert next(r for r in got if r.doc_id == 1002).score == 0


def test_text_ids(spark):
    rows, labels = corpus(120)
    kind = "doc_id string, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(f"d{i}", *rest) for i, *rest in rows] + [(None, None, None, None, None)], kind)
    marks = spark.createDataFrame([(f"d{i}", q, t) for i, q, t in labels], "doc_id string, quality int, toxic int")
    for got in (quality.quality_query(docs, marks), toxicity.toxicity_query(docs, marks), langid.language_query(docs)):
        got = got.collect()
        assert len(got) == 121 and all(r.held_out is None for r in got if r.doc_id is None)


def test_the_least_margin_grows_with_the_evidence(spark):
    rows, _ = corpus()
    model = langid.train(spark.createDataFrame(rows, DOCS))
    twin = langid.Model(["a", "b"], [model.dicts[0], model.dicts[0]])  # every text is a tie
    docs = spark.createDataFrame([(i, rows[0][1][:n], "en", "s", 0) for i, n in enumerate((3, 20, 60, 100))] + [(9, rows[0][1] * 20, "en", "s", 0)], DOCS)
    assert [r.rejected for r in langid.identify(docs, twin).orderBy("doc_id").collect()] == [False] * 4 + [True]


def test_toxicity_without_labels(spark):
    got = toxicity.toxicity_query(spark.createDataFrame(ODD, DOCS), spark.createDataFrame([], LABELS)).collect()
    assert len(got) == len(ODD) and all(r.score < 1e-6 for r in got)


def test_toxic_dictionary_is_cut_from_toxic_texts():
    rows, labels = corpus(300)
    texts, y = [t for _, t, *_ in rows], np.array([t for _, _, t in labels])
    model = toxicity.fit(texts, y)
    head = model.toxic[: -len(model.ordinary)].decode()
    assert model.toxic.endswith(model.ordinary) and all(w in head for w in ("grubfinker", "snotwangler", "blatherskunk"))
    toxic, ordinary = ([t.lower().encode() for t, c in zip(texts, y, strict=True) if c == want] for want in (1, 0))
    assert all(any(line in t for t in ordinary) for line in model.ordinary.split(b"\n"))
    gram, ratio = toxicity.contrast(toxic, [b"other words"] * 50)
    cut = toxicity.segments(toxic, gram, ratio, 100)
    assert 0 < len(cut) <= 101 and any(cut.strip().split(b" ")[0] in t for t in toxic)


def test_contrast_against_a_plain_count():
    rng = random.Random(4)
    toxic = [" ".join(rng.choices(["alpha", "beta", "nasty", "gamma"], k=6)).encode() for _ in range(40)]
    plain = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=6)).encode() for _ in range(60)]
    gram, ratio = toxicity.contrast(toxic, plain)
    got = {int(g).to_bytes(toxicity.GRAM, "little"): v for g, v in zip(gram, ratio, strict=True)}
    want = {}
    for g in {t[i : i + 4] for t in toxic for i in range(len(t) - 3)}:
        a, b = sum(g in t for t in toxic), sum(g in t for t in plain)
        table = [(a, 40, a + b), (b, 60, a + b), (40 - a, 40, 100 - a - b), (60 - b, 60, 100 - a - b)]
        value = 2 * sum(o * np.log(o * 100 / (r * c)) for o, r, c in table if o)
        if value >= toxicity.LEAST_RATIO and a / 40 > b / 60:
            want[g] = value
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-6 for g in want) and b"nast" in got


def test_window_gains_against_a_plain_loop():
    rows, labels = corpus(200)
    model = toxicity.fit([t for _, t, *_ in rows], np.array([t for _, _, t in labels]))
    texts = [t.encode() for _, t, *_ in rows[:12]] + [b"", "Ünïcode é snotwangler".encode()]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    row, gain = toxicity.gains(model.coders(), data, off)
    _, start, end = zdict.windows(data, off, toxicity.WINDOW)
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in data.tobytes())
    plain, toxic = model.coders()
    one = [int(plain.lengths(lower[a:b], np.array([0]), np.array([b - a]))[0] - toxic.lengths(lower[a:b], np.array([0]), np.array([b - a]))[0]) for a, b in zip(start, end, strict=True)]
    assert gain.tolist() == one and gain.max() >= 2


def test_windows_cover_every_byte():
    texts = [b"", b"one", b"a few words here and there " * 50, b"y" * 5000, b" " * 300]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    row, start, end = zdict.windows(data, off, 64)
    for i in range(len(texts)):
        s, e = start[row == i], end[row == i]
        assert s[0] == off[i] and e[-1] == off[i + 1] and (s[1:] == e[:-1]).all()
    length = zdict.Coder(b"some content " * 20).lengths(data.tobytes(), start, end)
    assert (length[end > start] > 0).all() and (length[end == start] == 0).all()
