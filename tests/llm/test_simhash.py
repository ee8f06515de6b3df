import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltweave.llm import simhash

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType())])


def brute_roots(fp, radius=simhash.RADIUS):
    """Fingerprint to the smallest fingerprint of its component, from all pairs."""
    parent = {x: x for x in fp}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(parent), 2):
        if (a ^ b).bit_count() <= radius:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def families(seed, n, k, flips):
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, 2**64, size=max(1, n // k), dtype=np.uint64)
    fp = centre[rng.integers(0, len(centre), n)]
    for _ in range(flips):
        fp = fp ^ np.where(rng.random(n) < 0.6, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    return np.unique(fp)


@pytest.mark.parametrize(("n", "k", "flips", "groups"), [(300, 1, 2, 1), (600, 6, 4, 1), (600, 60, 3, 3), (500, 500, 2, 1)])
def test_index_matches_all_pairs(n, k, flips, groups):
    fp = families(n + k, n, k, flips)
    group = np.random.default_rng(0).integers(0, groups, len(fp))
    a, b = simhash.group_links(group, fp)
    for g in range(groups):
        own = [int(x) for x in fp[group == g]]
        parent = {x: x for x in own}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for p, q in zip(a.tolist(), b.tolist(), strict=True):
            if p in parent:
                parent[max(find(p), find(q))] = min(find(p), find(q))
        roots = brute_roots(own)
        by = {}
        for x in own:
            by.setdefault(find(x), set()).add(roots[x])
        assert all(len(v) == 1 for v in by.values()) and len(by) == len(set(roots.values()))


@pytest.mark.parametrize(("bucket_rows", "hot_rows"), [(2048, simhash.HOT_ROWS), (7, 3)])
def test_links_close_to_the_components_of_all_pairs(spark, bucket_rows, hot_rows):
    fp = families(3, 400, 20, 4)
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp bigint")
    found = {r.node: r.root for r in simhash.components(simhash.link_fingerprints(df, bucket_rows=bucket_rows, hot_rows=hot_rows), hot_rows=hot_rows).collect()}
    roots = brute_roots([int(x) for x in fp])
    back = lambda x: x & (2**64 - 1)
    by = {}
    for x in fp.view(np.int64).tolist():
        by.setdefault(found.get(x, x), set()).add(roots[back(x)])
    assert all(len(v) == 1 for v in by.values()) and len(by) == len(set(roots.values()))


def test_chain_of_links_is_one_component(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(900, 901)], "a bigint, b bigint")
    got = {r.node: r.root for r in simhash.components(links).collect()}
    assert len(got) == 203 and all(got[i] == 0 for i in range(201)) and got[901] == 900


def test_components_at_once_and_by_rounds(spark):
    rng = np.random.default_rng(11)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-(2**62), 2**62, 300)[rng.integers(0, 300, (260, 2))]] + [(5, 5)]
    links = spark.createDataFrame([*pairs, *[(b, a) for a, b in pairs[:50]]], "a bigint, b bigint")
    once, rounds = (sorted(map(tuple, simhash.components(links, task_links=n).collect())) for n in (simhash.TASK_LINKS, 0))
    assert once == rounds and {n for n, _ in once} == {x for p in pairs if p[0] != p[1] for x in p}
    assert simhash.components(links.where("a > b and a < b")).count() == 0


def test_few_stages_for_the_driver(spark):
    """Closing components and looking up rows of a small table makes no rounds of joins, whose stages fill the driver's memory."""
    rows = [(i, " ".join(f"w{i // 3}x{j}" for j in range(40)) + " end" * (i % 3), "") for i in range(90)]
    docs = spark.createDataFrame(rows, SCHEMA)
    sc = spark.sparkContext
    sc.setJobGroup("few-stages", "keep_one")
    try:
        kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
        jobs = sc.statusTracker().getJobIdsForGroup("few-stages")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    assert kept >= set(range(0, 90, 3)) and len(kept) < 60
    assert 0 < len(jobs) < 45


TEXTS = [
    (5, "one two three four five six seven eight nine ten", "x"), (3, "One two three four five six seven eight nine TEN", "y"),
    (9, None, "z"), (7, "", "z"), (8, " \t\n", "z"), (2, "solo", None), (2, "solo", None), (None, "solo", "q"),
    (11, "Ünïcode É words stay whole here and there", "w"), (12, "word " * 30_000, "long"), (None, "nobody has this one text", None),
]


def test_query_on_odd_rows(spark):
    docs = spark.createDataFrame(TEXTS, SCHEMA)
    rows = simhash.simhash_query(docs).collect()
    assert len(rows) == len(TEXTS)
    want = {t: f"{plain_fingerprint(t):016x}" for _, t, _ in TEXTS}
    assert sorted((str(r.doc_id), r.fingerprint) for r in rows) == sorted((str(i), want[t]) for i, t, _ in TEXTS)
    roots = {(r.doc_id, r.fingerprint): r.component_id for r in rows}
    assert roots[5, want[TEXTS[0][1]]] == 3 and roots[9, "0" * 16] == 7 and roots[None, want["solo"]] == 2
    assert roots[None, want["nobody has this one text"]] is None


@pytest.mark.parametrize("hot_rows", [simhash.HOT_ROWS, 1])
def test_one_row_of_each_group_stays(spark, hot_rows):
    docs = spark.createDataFrame(TEXTS, SCHEMA)
    kept = simhash.keep_one(docs, hot_rows=hot_rows)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["11", "12", "2", "3", "7", "None"]


def test_hot_keys_change_nothing(spark):
    rows = [(i, f"text {i % 4} shared by many rows of one key", "") for i in range(40)] + [(100 + i, f"{i} alone it stands {i * i}", "") for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    plain, hot = (sorted(simhash.near_duplicates(docs, hot_rows=n).collect()) for n in (simhash.HOT_ROWS, 2))
    assert plain == hot and len(plain) == 60
    side = spark.createDataFrame([("a", 7, 3), ("b", 8, 1), ("c", 9, 0)], "k string, v int, n int")
    got = simhash.hot_join(spark.createDataFrame([("a",), ("a",), ("a",), ("b",), (None,)], "k string"), side, "k", "n", 5, 2)
    assert got.columns == ["k", "v"] and sorted(map(tuple, got.collect())) == [("a", 7)] * 3 + [("b", 8)]


def test_clashing_ids_lose_no_component(spark):
    near, other = TEXTS[0][1], "a wholly different text about rivers and the boats that go on them every day"
    rows = [(1, near, "a"), (1, other, "b"), (2, "third thing that nobody else has said before in here", "c"), (2, near.upper(), "d"), (9, None, "e"), (9, None, "f")]
    rows += [(None, "nobody has this text", "g"), (None, "nobody has this text", "h"), (None, other, "i")]
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted((str(i), str(t)) for i, t, _ in (rows[0], rows[1], rows[2], rows[4], rows[6]))


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def edited(rng, text, share):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) if rng.random() < share else w for w in text.split())


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(2500)]
    own = [" ".join(rng.choices(vocabulary, k=rng.randint(80, 400))) for _ in range(300)]
    rows = [(i, t, "") for i, t in enumerate(own)]
    near, far = [], []
    for i, t in enumerate(own[:200]):
        x = edited(rng, t, rng.choice([0.005, 0.01, 0.015, 0.1]))
        (near if jaccard(t, x) >= 0.8 else far if jaccard(t, x) < 0.6 else []).append(1000 + i)
        rows.append((1000 + i, x, ""))
    got = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got >= set(range(300)) and len(near) > 90 and len(far) > 30
    assert np.mean([i not in got for i in near]) >= 0.9 and np.mean([i in got for i in far]) >= 0.95


def test_confirmed_links_against_all_pairs():
    rng = np.random.default_rng(7)
    fp = np.repeat(families(9, 200, 10, 4), 2)
    base = rng.integers(0, 2**64, (3, 4), dtype=np.uint64)
    wide = base[rng.integers(0, 3, len(fp))] ^ (np.uint64(1) << rng.integers(0, 64, (len(fp), 4)).astype(np.uint64))
    node = np.arange(len(fp))
    a, b = simhash.group_links(np.zeros(len(fp), np.int64), fp, 7, node, wide)
    parent = list(range(len(fp)))

    def find(parent, x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p, q in zip(a.tolist(), b.tolist(), strict=True):
        parent[max(find(parent, p), find(parent, q))] = min(find(parent, p), find(parent, q))
    plain = list(range(len(fp)))
    for i, j in combinations(range(len(fp)), 2):
        if int(fp[i] ^ fp[j]).bit_count() <= 7 and sum(int(v).bit_count() for v in wide[i] ^ wide[j]) <= simhash.WIDE_LIMIT:
            plain[max(find(plain, i), find(plain, j))] = min(find(plain, i), find(plain, j))
    assert [find(parent, i) for i in node] == [find(plain, i) for i in node] and 1 < len({find(plain, i) for i in node}) < len(fp)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.simhash_query(docs).count() == 0
    assert simhash.keep_one(docs).count() == 0


def test_fingerprint_uses_spark_xxhash(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] == np.uint64(xxhash.xxh64_intdigest("a b c d", 42)).view(np.int64)
