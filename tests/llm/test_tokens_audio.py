import hashlib
import base64
import random
import struct
import zlib

import numpy as np
import pytest
import sentencepiece

from voltweave.llm import audio, packing, pieces

from .data import DOCS, ODD, corpus

MODEL = pieces.load()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)


def ids_of(encoded):
    return [None if x is None else np.frombuffer(x, "<i4").tolist() for x in encoded]


def strange(n=4000, seed=2):
    rng = random.Random(seed)
    alpha = "abcdefghijklmnopqrstuvwxyz ABC.,\n\té中文日本0123()[]{}<>=_-+\"'\\/:;#🎉ﬁ"
    own = [p.replace(pieces.SPACE, " ") for p in MODEL.pieces[259:]]
    return ["".join(rng.choice(alpha) for _ in range(rng.randint(0, 50))) for _ in range(n // 2)] + ["".join(rng.choice(own) for _ in range(rng.randint(1, 8))) for _ in range(n // 2)]


def test_ids_equal_the_library_and_decode_back():
    codec = pieces.Codec(MODEL)
    texts = [t for _, t, *_ in corpus(60)[0]] + strange() + ["", " ", "     a", "a" * 3000, "x y" * 500, "\n\n\t", "                 "]
    got = ids_of(codec.encode(texts))
    assert got == [LIBRARY.encode(t) for t in texts] and [codec.decode(x) for x in got] == texts


def test_the_space_sign_itself_survives():
    codec = pieces.Codec(MODEL)
    for t in ("▁", "a▁b", "▁▁ x", " ▁"):
        assert codec.decode(ids_of(codec.encode([t]))[0]) == t


def test_may_follow_agrees_with_merging():
    rng = random.Random(1)
    ids = list(MODEL.usable.values())
    a, b = np.array(rng.sample(ids, 1500)), np.array(rng.sample(ids, 1500))
    keep = [i for i in range(1500) if not MODEL.tied_in.search(MODEL.pieces[a[i]] + MODEL.pieces[b[i]])]
    want = [MODEL.merge(MODEL.pieces[a[i]] + MODEL.pieces[b[i]]) == [a[i], b[i]] for i in keep]
    assert MODEL.may_follow(a[keep], b[keep]).tolist() == want


def field(number, payload):
    return bytes([number << 3 | 2, len(payload)]) + payload


def test_unigram_models_take_the_best_sum():
    rng = random.Random(3)
    names = ["a", "b", "c", "ab", "bc", "abc", "ca", "▁", "▁a", "▁ab"]
    score = {p: -rng.uniform(1, 6) for p in names}
    raw = field(1, field(1, b"<unk>") + b"\x18\x02") + b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", score[p])) for p in names) + field(2, b"\x18\x01")
    model = pieces.Model(raw)
    stretches = ["▁" + "".join(rng.choice("abc") for _ in range(n)) for n in range(1, 9) for _ in range(5)]

    def best(s):
        top = {0: (0.0, [])}
        for i in range(1, len(s) + 1):
            top[i] = max(((top[j][0] + model.scores[model.usable[s[j:i]]], top[j][1] + [model.usable[s[j:i]]]) for j in range(i) if s[j:i] in model.usable and j in top), key=lambda x: x[0])
        return top[len(s)][1]

    assert ids_of(model.encode_stretches(stretches)) == [best(s) for s in stretches]


def test_encode_and_decode_tables(spark):
    rows = corpus(30)[0] + ODD
    docs = spark.createDataFrame(rows, DOCS)
    out = pieces.encode_documents(docs, MODEL)
    got = sorted((str(r.doc_id), r.ids, r.n_ids) for r in out.collect())
    want = sorted((str(i), None if t is None else LIBRARY.encode(t), None if t is None else len(LIBRARY.encode(t))) for i, t, *_ in rows)
    assert got == want
    back = sorted((str(r.doc_id), r.text or "") for r in pieces.decode_documents(out, MODEL).collect())
    assert back == sorted((str(i), t or "") for i, t, *_ in rows)
    q = pieces.pieces_query(docs, MODEL).collect()
    assert len(q) == len(rows) and all(r.round_trip for r in q) and pieces.pieces_query(docs.limit(0), MODEL).count() == 0


# -- packing -------------------------------------------------------------------------------------


def plain_best_fit(sizes, capacity):
    rows = []
    for p in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [r for r in rows if r[0] >= sizes[p]]
        row = min(fits, key=lambda r: r[0]) if fits else None
        if row is None:
            row = [capacity]
            rows.append(row)
        row[0] -= sizes[p]
    return sorted(r[0] for r in rows)


@pytest.mark.parametrize("seed", range(10))
def test_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 101, int(rng.integers(0, 90)))
    rows = packing.best_fit(sizes, 100)
    assert sorted(x for r in rows for x in r) == list(range(len(sizes)))
    assert sorted(100 - int(sizes[r].sum()) for r in rows) == plain_best_fit(sizes.tolist(), 100)


def test_packed_rows_hold_every_document(spark):
    rows = corpus(40)[0] + ODD
    packed = [r.asDict() for r in packing.pack_documents(spark.createDataFrame(rows, DOCS), packing.load_ranks(), seq_len=128, group_tokens=3000).collect()]
    own = packing.encoder(packing.load_ranks())
    whole = {}
    for r in packed:
        assert len(r["ids"]) == 256 and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_ids"] == 128 - r["pad"] and r["resets"] == r["cu_seqlens"][:-1]
        assert (packing.position_ids(r)[r["resets"]] == 0).all()
        for d, row, at, ids in packing.unpack(r):
            whole.setdefault((str(d), row), []).append((at, ids.tolist()))
    got = sorted((d, sum((ids for _, ids in sorted(own_)), [])) for (d, _), own_ in whole.items())
    assert got == sorted((str(i), own.encode_ordinary(t) + [packing.end_id(packing.load_ranks())]) for i, t, *_ in rows if t)


def test_large_vocabulary_gets_wide_ids(spark):
    tokens = [bytes([i]) for i in range(256)] + [bytes([i, j]) for i in range(256) for j in range(256)]
    ranks = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens))
    docs = spark.createDataFrame([(1, "ÿÿ hello þÿ", "en", "s", 0), (2, "\u00ff\u00fe" * 9, "en", "s", 0)], DOCS)
    rows = [r.asDict() for r in packing.pack_documents(docs, ranks, seq_len=64).collect()]
    assert packing.id_type(ranks) == "<u4" and packing.end_id(ranks) == 65_792 and all(len(r["ids"]) == 256 for r in rows)
    own, got = packing.encoder(ranks), {d: ids.tolist() for r in rows for d, _, _, ids in packing.unpack(r)}
    assert got == {d: own.encode_ordinary(t) + [65_792] for d, t, *_ in docs.collect()} and max(map(max, got.values())) >= 1 << 16


def test_packing_with_a_clashing_column(spark):
    docs = spark.createDataFrame([(1, "some text", "x", 5)], "doc_id long, text string, k string, r int")
    assert packing.pack_documents(docs, packing.load_ranks()).count() == 1 and packing.pack_documents(docs.limit(0), packing.load_ranks()).count() == 0


def test_broken_audio_files_have_a_status(spark):
    good = audio.wav(b"\xff" * 100, audio.MULAW)
    files = [good, good[:30], good[:22], good[:12] + b"fmt \x10\0\0\0", audio.wav(b"\xff" * 10, audio.MULAW, rate=(1 << 32) - 1), b"", None, b"RIFF" + b"\0" * 40]
    media = spark.createDataFrame([(i, f, i) for i, f in enumerate(files)], "id int, m binary, k int")
    got = {r.id: (r.status, r.pcm is not None) for r in audio.to_pcm(media, "m", "id").collect()}
    assert got[0] == ("ok", True) and all(s != "ok" and not made for i, (s, made) in got.items() if i) and len(got) == len(files)


def test_long_texts_are_cut_where_the_pattern_splits(monkeypatch):
    monkeypatch.setattr(packing, "PART_CHARS", 50)
    own = packing.encoder(packing.load_ranks())
    for t in [t for _, t, *_ in corpus(20)[0]] + strange(300) + ["x" * 400, " " * 300]:
        assert sum((own.encode_ordinary(p) for p in packing.parts(t)), []) == own.encode_ordinary(t)


# -- audio ---------------------------------------------------------------------------------------


def plain_adpcm(block):
    value, index = struct.unpack_from("<hB", block)
    index, out = min(index, 88), [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(audio.STEP_SIZE[index])
            diff = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
            index = max(0, min(88, index + int(audio.INDEX_STEP[code & 7])))
            out.append(value)
    return out


def test_adpcm_across_blocks():
    blocks = np.random.default_rng(0).integers(0, 256, (7, 96), dtype=np.uint8)
    assert audio.adpcm_decode(blocks).tolist() == [plain_adpcm(b.tobytes()) for b in blocks]


def test_companding_tables():
    mu, a = audio.mulaw_table().astype(int), audio.alaw_table().astype(int)
    assert mu[0xFF] == 0 and mu[0x00] == -32124 and mu[0x80] == 32124 and (mu[:128] == -mu[128:]).all()
    assert a[0xD5] == 8 and a[0x55] == -8 and a[0x2A] == -32256 and a[0xAA] == 32256 and (a[:128] == -a[128:]).all()


def test_resampling_keeps_samples():
    x = np.random.default_rng(1).integers(-30000, 30000, 500).astype(np.int16)
    y = audio.resample(x)
    assert len(y) == 1000 and (y[::2] == x).all() and audio.resample(np.full(9, 77, np.int16)).tolist() == [77] * 18 and len(audio.resample(x[:0])) == 0


def test_stored_files_read_back(spark):
    raw = bytes(range(256)) * 9
    rows = [(1, audio.wav(raw, audio.MULAW)), (2, audio.wav(raw, audio.ALAW)), (3, audio.wav(raw, audio.ADPCM, block=576, bits=4)), (4, b"junk"), (5, None), (6, b""), (7, audio.wav(raw[:577], audio.ADPCM, block=576, bits=4)), (8, audio.wav(raw, 99))]
    got = {r.k: r for r in audio.to_pcm(spark.createDataFrame(rows, "k long, m binary"), "m", "k").collect()}
    assert [got[i].status for i in (1, 2, 3, 7)] == ["ok"] * 4 and all(got[i].pcm is None and got[i].status != "ok" for i in (4, 5, 6, 8))
    rate, x = audio.decode(bytes(got[1].pcm))
    assert rate == 16000 and x[::2].tolist() == audio.mulaw_table()[list(raw)].tolist()
    assert audio.decode(bytes(got[3].pcm))[1][::2].tolist() == sum((plain_adpcm(raw[i : i + 576]) for i in range(0, len(raw), 576)), [])


def test_audio_query(spark):
    rows = corpus(20)[0] + ODD
    got = audio.audio_query(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, t, *_ in rows:
        b = (t or "").encode()
        p = b + b"\xff" * (-len(b) % 576 if b else 576)
        f = audio.wav(p, audio.MULAW)
        for r in by[i]:
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
            assert (r.media_bytes, r.media_sha256) == (len(f), hashlib.sha256(f).hexdigest())
    assert len({r.feature for r in by[1007]}) == 1 and by[1001][0].feature == by[1002][0].feature
    assert audio.audio_query(spark.createDataFrame([], DOCS)).count() == 0
