import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltweave.llm import decontaminate, html_extract, pii

from .data import DOCS, ODD, corpus


# -- personal data -------------------------------------------------------------------------------


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d), 1):
        v = int(c)
        total += v if k % 2 else 2 * v - (9 if v > 4 else 0)
    return total % 10 == 0


def base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def digest(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def personal(seed, n=200):
    rng = random.Random(seed)
    bits = ["a.b@c.de", "x@y", "q@r.s_t@u.v", "a@b.c@d.e", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.02.3.4", "99999999999999999999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112",
            "4111111111111111", "+1 (499) 555-6503", "+1 (499) 555-6503 4111111111111111", "+12", "++49 30 1234567", "+1 . 5", "é", "😀", "word", "12", "-", " ", "\n", "@", ".com", "123456789012345678901234567890"]
    return [(i, "".join(rng.choice(bits) + rng.choice([" ", "", ", "]) for _ in range(rng.randint(1, 12))), "en", "s", 0) for i in range(n)]


def test_base_spans_match_plain_patterns(spark):
    rows = personal(1) + ODD + [(7001, "4111 1111 1111 1111 " * 4000, "en", "s", 0), (7002, "1." * 20_000, "en", "s", 0), (7003, "9" * 50_000, "en", "s", 0)]
    got = pii.pii_query(spark.createDataFrame(rows, DOCS)).collect()
    want = sorted((hashlib.sha256(digest(base(t or "")).encode()).hexdigest(), str(i)) for i, t, *_ in rows)
    assert sorted((r.base_sha256, str(r.doc_id)) for r in got) == want
    by = {r.doc_id: r for r in got}
    for i, t, *_ in rows[:200]:
        b = base(t)
        assert [by[i].n_email, by[i].n_ip, by[i].n_card, by[i].n_phone] == [sum(k == j for _, k, _ in b) for j in range(4)]
        assert set(digest(b).split(",")) <= set(by[i].spans.split(",")) | {""}


def test_candidates_add_what_stands_side_by_side(spark):
    rng = random.Random(5)
    rows = [(i, f"call {'+1 (%03d) 555-%04d' % (rng.randrange(200, 999), rng.randrange(9999)) if i % 2 else '4111111111111111'} now please", "en", "s", 0) for i in range(300)]
    rows.append((900, "both +1 (499) 555-6503 4111111111111111 here", "en", "s", 0))
    got = {r.doc_id: r.spans for r in pii.pii_query(spark.createDataFrame(rows, DOCS)).collect()}
    assert digest(base(rows[-1][1])) == "" and got[900] == "phone:5:22,card:23:39"


def spelt(rng, kind):
    """A random value of a kind and disguised forms of it."""
    if kind == "email":
        a, b = f"user{rng.randrange(99)}.x", f"mail{rng.randrange(9)}.example.com"
        return f"{a}@{b}", [f"{a} [at] {b}", f"{a}(at){b}", f"{a.replace('.', ' dot ')} at {b.replace('.', ' dot ')}", f"{a} (at) {b.replace('.', ' (dot) ')}"]
    if kind == "ip":
        p = [str(rng.randrange(256)) for _ in range(4)]
        return ".".join(p), ["[.]".join(p), " . ".join(p), "[dot]".join(p)]
    if kind == "card":
        d = "".join(str(rng.randrange(10)) for _ in range(15))
        d += next(str(c) for c in range(10) if luhn(d + str(c)))
        return d, [sign.join(d[i : i + 4] for i in range(0, 16, 4)) for sign in (".", "/", "_")]
    a, b, c = rng.randrange(200, 999), rng.randrange(200, 999), rng.randrange(1000, 9999)
    return f"+1 ({a}) {b}-{c}", [f"1 ({a}) {b}-{c}", f"001 ({a}) {b}-{c}", f"1.{a}.{b}.{c}", f"1-{a}-{b}-{c}"]


def test_disguised_data_is_found_and_other_numbers_are_left(spark):
    rng = random.Random(8)
    lead = ["they said that", "we all went to", "and then a", "in the morning", "look at"]
    rows, want = [], {}
    for i in range(1600):
        kind = ("email", "ip", "card", "phone")[i % 4]
        rows.append((i, f"{rng.choice(lead)} {spelt(rng, kind)[0]} {rng.choice(['now', 'and so on', 'was here'])}", "en", "s", 0))
    for i in range(2000, 2400):
        kind = ("email", "ip", "card", "phone")[i % 4]
        x = rng.choice(spelt(rng, kind)[1])
        text = f"{rng.choice(['someone wrote', 'it reads', 'we found'])} {x} {rng.choice(['today', 'again'])}"
        at = text.index(x)
        rows.append((i, text, "en", "s", 0))
        want[i] = f"{kind}:{at}:{at + len(x)}"
    for i in range(3000, 3200):
        d = spelt(rng, "card")[0]
        other = [f"order {rng.randrange(10**9, 10**10)}", "version 1.20.3", f"see page {rng.randrange(999)} of 1.999.3.777", f"the sum is {d[:-1]}{(int(d[-1]) + 1) % 10}", "at noon we dot the i", "12 34 56", "section 3.2.1 and 4.5"][i % 7]
        rows.append((i, f"clean {other} text", "en", "s", 0))
    for i in range(3500, 3600):
        rows.append((i, f'and {rng.choice(["token", "api_key", "password"])} = "{rng.randbytes(16).hex()}" here' if i < 3580 else "a longwordwithoutanydigitsinit and pathological/sequences/of-words", "en", "s", 0))
    got = {r.doc_id: r for r in pii.pii_query(spark.createDataFrame(rows, DOCS)).collect()}
    found = {k: np.mean([want[i] in got[i].spans.split(",") for i in want if want[i].startswith(k)]) for k in ("email", "ip", "card", "phone")}
    assert min(found.values()) >= 0.9, found
    false = [(r[1], got[r[0]].spans) for r in rows if (3000 <= r[0] < 3200 or r[0] >= 3580) and got[r[0]].n_spans]
    assert len(false) <= 6, false
    assert np.mean([got[i].spans.startswith("secret:") for i in range(3500, 3580)]) >= 0.9


def test_trees_in_sql_equal_the_trees(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (300, len(pii.FEATURES)))
    true, false = rng.integers(0, 9, 300) * (x[:, 2] > 2), rng.integers(0, 9, 300) * (x[:, 4] < 5)
    model = pii.fit(x, rng.integers(0, 4, 300), true, false, true, false)
    assert len(model.trees) == pii.ROUNDS and any(not isinstance(t, float) for t in model.trees)
    got = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "i int, f array<int>").select("i", F.expr(model.sql("f")).alias("s")).orderBy("i").collect()
    assert np.allclose([r.s for r in got], model.bias + sum(pii._apply(t, x) for t in model.trees))


def test_very_many_spans_in_one_text(spark):
    text = "".join(f"4111 1111 1111 1111, a{i}@b.cd; +1 (499) 555-{i % 10000:04} 10.0.0.{i % 256} x{i} [at] y.de " for i in range(11_000))
    docs = spark.createDataFrame([(1, text, "en", "s", len(text))], DOCS).repartition(1)
    model = pii.Model([], 1.0, {r: 0.5 for r in range(4)})  # adds every candidate that overlaps nothing
    began = time.perf_counter()
    f = docs.select(F.expr(pii._found(model, "text")).alias("f")).select(F.size("f.base").alias("base"), F.size("f.spans").alias("spans")).first()
    out = pii.redact(docs, model).first()
    assert f.base == 33_000 and f.spans == 55_000  # the phone pattern runs into the address
    assert time.perf_counter() - began < 120
    assert out.text == "".join(f"<CARD>, <EMAIL>; <PHONE> <IP> <EMAIL> " for i in range(11_000)) and out.n_chars == len(out.text)


def test_redaction_against_a_plain_cut(spark):
    rng = random.Random(6)
    rows = [(i, "é" * rng.randrange(4090, 4100) + t, "en", "s", 0) for i, t, *_ in personal(9, 60)] + [(900, "a.b" * 3000 + "@c.de x", "en", "s", 0), (901, "x 1.2.3.4@b.co +1 (499) 555-6503", "en", "s", 0)]
    got = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, DOCS), pii.Model()).collect()}
    for i, t, *_ in rows:
        at, out = 0, ""
        for s, k, e in base(t):
            if e > at:
                out += t[at:s] + ("" if s < at else f"<{pii.KINDS[k].upper()}>")
                at = e
        assert got[i] == out + t[at:]


def test_redaction(spark):
    rows = [(1, "mail a.b@c.de or 1.2.3.4!", "en", "s", 25), (2, None, "en", "s", None), (3, "clean", "en", "s", 5), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("t", F.lit(1)).withColumn("f", F.lit("x"))
    out = pii.redact(docs, pii.Model())
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: ("mail <EMAIL> or <IP>!", 21), 2: (None, None), 3: ("clean", 5), 4: ("", 0)}


def test_personal_data_on_empty_table(spark):
    assert pii.pii_query(spark.createDataFrame([], DOCS)).count() == 0


# -- decontamination -----------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def plain_scan(text, items):
    w, hit, found = words(text), set(), set()
    for key, item in items:
        x = words(item)
        n = min(10, len(x))
        grams = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(key)
    return len(w), len(hit), sorted(map(str, found))


ITEMS = [(1, "One two three, four five six seven eight nine ten eleven twelve"), (2, "Short É item"), (3, None), (4, "..."), (10, "five six seven eight nine ten eleven twelve thirteen fourteen"), (1, "One two three, four five six seven eight nine ten eleven twelve")]
TEXTS = [
    "x one TWO three four five six seven eight nine ten y", "one two three four five six seven eight nine", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen",
    "a short É item, a short é item", "", None, "?!", "one two three four five six seven eight nine ten " * 300, "short É item",
]


@pytest.mark.parametrize("set_windows", [decontaminate.SET_WINDOWS, 3])
def test_scan_matches_plain_words(spark, set_windows):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "en", "s", 0), (None, TEXTS[0], "en", "s", 0)]
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate.scan(docs, bench, set_windows=set_windows).select("r.doc_id", "n_words", decontaminate.covered(F.col("hits")).alias("n_hit"), "items")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, sorted(map(str, r["items"]))) for r in out.collect())
    assert got == sorted((str(i), *plain_scan(t, ITEMS)) for i, t, *_ in rows)
    kept = decontaminate.remove_contaminated(docs.withColumn("w", F.lit(1)), bench, set_windows=set_windows)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t, *_ in rows if not plain_scan(t, ITEMS)[1]) and kept.columns[-1] == "w"


@pytest.mark.parametrize("set_windows", [decontaminate.SET_WINDOWS, 3])
def test_items_with_a_null_id_hit(spark, set_windows):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(TEXTS)]
    items = [(None, ITEMS[0][1]), (None, "Short É item"), (10, ITEMS[4][1])]
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.scan(docs, bench, set_windows=set_windows).select("r.doc_id", decontaminate.covered(F.col("hits")).alias("n_hit"), "items").collect()
    want = {i: plain_scan(t, items)[1:] for i, t, *_ in rows}
    assert {r.doc_id: (r.n_hit, [str(x) for x in r["items"]]) for r in out} == {i: (n, [x for x in ids if x != "None"]) for i, (n, ids) in want.items()}
    kept = decontaminate.remove_contaminated(docs, bench, set_windows=set_windows)
    assert {r.doc_id for r in kept.collect()} == {i for i, (n, _) in want.items() if not n}


def test_scan_with_empty_tables(spark):
    docs, none = spark.createDataFrame(ODD, DOCS), spark.createDataFrame([], "item_id long, text string")
    out = decontaminate.decontamination_query(docs, none).collect()
    assert len(out) == len(ODD) and not any(r.contaminated for r in out) and {r.items_sha256 for r in out} == {hashlib.sha256(b"").hexdigest()}
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.decontamination_query(spark.createDataFrame([], DOCS), bench).count() == 0


def test_large_benchmark_and_long_documents(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([4, 7, 60, 90])))) for i in range(400)]
    items += [(1000 + i, " ".join(rng.choices(vocabulary, k=2000))) for i in range(12)]  # some 40,000 windows in all
    texts = [" ".join(rng.choices(vocabulary, k=20_000)) for _ in range(4)]
    for i in (0, 2):  # a passage in a very long text, its middle, and one near the end
        w = texts[i].split()
        w[5000:5060], w[19_990:] = words(items[1000 - 1000 + i + 400][1])[100:160], words(items[i + 401][1])[:10]
        texts[i] = " ".join(w)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([*texts, texts[0], "clean words only"])]
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    windows = decontaminate.benchmark_windows(bench)
    assert windows.count() > 20_000
    grams: dict = {}
    for key, item in items:
        x = words(item)
        n = min(10, len(x))
        for i in range(len(x) - n + 1):
            grams.setdefault(tuple(x[i : i + n]), set()).add(key)
    want = {}
    for i, t, *_ in rows:
        w, hit, found = words(t), set(), set()
        for n in (4, 7, 10):
            for j in range(len(w) - n + 1):
                if ids := grams.get(tuple(w[j : j + n])):
                    hit |= set(range(j, j + n))
                    found |= ids
        want[i] = (len(w), len(hit), sorted(found))
    assert want[0][1] >= 70 and not want[5][1]
    for size in (decontaminate.SET_WINDOWS, 15_000):  # one set, and several
        out = decontaminate.scan(docs, bench, set_windows=size)
        got = {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"])) for r in out.select("r.doc_id", "n_words", decontaminate.covered(F.col("hits")).alias("n_hit"), "items").collect()}
        assert got == want
        assert {r.doc_id for r in decontaminate.remove_contaminated(docs, bench, set_windows=size).collect()} == {i for i, x in want.items() if not x[1]}


def test_text_is_on_no_exploded_row(spark):
    docs, bench = spark.createDataFrame(ODD, DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    plan = decontaminate.scan(docs, bench)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate")]
    assert "text#" not in above and "source#" not in above


def test_digest_sorts_ids_as_text(spark):
    docs = spark.createDataFrame([(1, TEXTS[2], "en", "s", 0)], DOCS)
    r = decontaminate.decontamination_query(docs, spark.createDataFrame(ITEMS + [(2, TEXTS[2])], "item_id long, text string")).first()
    assert r.n_items == 3 and r.items_sha256 == hashlib.sha256(b"1,10,2").hexdigest()


# -- pages ---------------------------------------------------------------------------------------


def test_article_of_a_page_with_everything():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
    <header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></li><li><a href="/b">News</a></li></ul></nav>
    <div class="cookie-banner">We value your privacy a great deal and set many cookies to prove it to you.</div>
    <main><article><h1>Title &amp; more</h1><p>A first   paragraph with <b>bold</b>
    words &mdash; and an entity.<p>Short.</p><aside>Read also: a long line of other things that you may like.</aside>
    <ul><li>A point that matters</li></ul><form><p>Your mail please</p></form><div class="ad">Buy this now and never stop buying it.</div>
    <p>Last one.</p><section id="comments"><p>A reader says that all of this is wrong and always was.</p></section></article></main>
    <div id="sidebar"><p>Side text that is as long as a paragraph of the article itself.</p></div><footer>&copy; us</footer></body></html>"""
    assert html_extract.main_text(page) == "Title & more\nA first paragraph with bold words — and an entity.\nShort.\nA point that matters\nLast one."


def test_page_without_article_element():
    page = "<body><div id='menu'><a href=1>One</a> <a href=2>Two</a></div><div class='content'>" + "".join(f"<p>Paragraph number {i} has some words in it, and a few more.</p>" for i in range(6)) + "<p>End</p></div><div class='footer'><p>All rights reserved by the people who made this page.</p></div></body>"
    assert html_extract.main_text(page) == "\n".join([f"Paragraph number {i} has some words in it, and a few more." for i in range(6)] + ["End"])


LONG = [f"Paragraph number {i} has some words in it, and a few more." for i in range(6)]
BODY = "".join(f"<p>{x}</p>" for x in LONG)


@pytest.mark.parametrize("wrapper", ["form", "div class='content has-sidebar'", "div class='no-sidebar'", "div id='page-header-fixed'", "div class='social'", "section class='legal'"])
@pytest.mark.parametrize("body", [BODY, f"<article>{BODY}</article>", f"<main>{BODY}</main>"])
def test_wrapper_with_a_telling_name_keeps_the_page(wrapper, body):
    page = f"<body><nav><a href=1>One</a></nav><{wrapper}>{body}<div class='sidebar'><p>Side text beside the page.</p></div></{wrapper.split()[0]}><footer><p>All rights reserved.</p></footer></body>"
    assert html_extract.main_text(page) == "\n".join(LONG)


def test_teasers_beside_the_article_stay_aside():
    teaser = "<article><p>Read the other story that we have.</p></article>"
    for beside in (f"<aside>{teaser}</aside>", f"<div class='related'>{teaser}</div>", "<form><p>Your mail and your name please, and then send it.</p></form>"):
        assert html_extract.main_text(f"<body><article>{BODY}</article>{beside}</body>") == "\n".join(LONG)


def test_main_with_text_outside_its_article():
    page = f"<body><main><h1>Title of it</h1>{BODY}<article>{BODY[: len(BODY) // 2]}</article></main><footer>us</footer></body>"
    assert html_extract.main_text(page) == "\n".join(["Title of it", *LONG, *LONG[:3]])


def test_text_beside_an_article():
    page = f"<body><nav><a href=1>One</a></nav><div>{BODY}</div><article>{BODY}</article><footer>us</footer></body>"
    assert html_extract.main_text(page) == "\n".join(LONG * 2)


def test_blocks_beside_one_very_long_block():
    page = f"<body><nav><a href=1>One</a></nav><div><h1>Headline of the page</h1></div><div><p>{LONG[0]}</p></div><div><p>{'many words ' * 400}</p></div><div><p>{LONG[1]}</p></div><div><p>{LONG[2]}</p></div><footer>us</footer></body>"
    assert html_extract.main_text(page) == "\n".join(["Headline of the page", LONG[0], ("many words " * 400).strip(), LONG[1], LONG[2]])


def test_linked_entries_of_an_article_stay():
    sources = "<h2>Sources</h2><ul><li><a href=1>First source</a></li><li><a href=2>Second source</a></li></ul><table><tr><td><a href=3>Linked cell</a></td></tr></table>"
    for tag in ("article", "main"):
        assert html_extract.main_text(f"<body><{tag}>{BODY}{sources}</{tag}></body>") == "\n".join([*LONG, "Sources", "First source", "Second source", "Linked cell"])
    menu, mixed = "<ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul>", f"<ul><li>{LONG[0]}</li><li><a href=1>Linked entry</a></li></ul>"
    assert html_extract.main_text(f"<body><div>{menu}{BODY}{mixed}</div></body>") == "\n".join([*LONG, LONG[0], "Linked entry"])


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<p>"), (4, "u", "plain &lt;text&gt;"), (5, "u", "<div>" * 3000 + "deep text" + "</div>" * 3000), (6, "u", "<article><p>open <b>tags <i>everywhere"), (6, "u", "<article><p>open <b>tags <i>everywhere"), (7, "u", "<script>never closed <p>x</p>")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in got if r.page_id < 7] == [(1, "", 0), (2, "", 0), (3, "", 0), (4, "plain <text>", 12), (5, "deep text", 9), (6, "open tags everywhere", 20), (6, "open tags everywhere", 20)]
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_clusters_choose_the_lines(monkeypatch):
    page = f"<body><nav><a href=1>One</a></nav><div><a href=2>Two</a></div><article><h1>Title</h1>{BODY}</article><footer><p>All rights reserved.</p></footer></body>"
    whole = "\n".join(["Title", *LONG])
    assert html_extract.main_text(page) == whole
    rng = np.random.default_rng(1)
    monkeypatch.setattr(html_extract, "clusters", lambda ratio, weight: rng.random(len(ratio)) < 0.5)
    assert len({html_extract.main_text(page) for _ in range(20)} - {whole}) > 10
    monkeypatch.setattr(html_extract, "clusters", lambda ratio, weight: np.ones(len(ratio), bool))
    assert html_extract.main_text(page) == "\n".join(["One", "Two", whole, "All rights reserved."])


def test_smoothing_and_threshold_against_a_plain_loop():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 40):
        ratio, weight = rng.exponential(20, n) * (rng.random(n) < 0.8), rng.choice([html_extract.BESIDE, 1.0, html_extract.ARTICLE], n)
        level = []
        for i in range(n):
            k = {j: np.exp(-0.5 * (i - j) ** 2) * weight[j] for j in range(n) if abs(i - j) <= 3}
            level.append(weight[i] * sum(np.log1p(ratio[j]) * v for j, v in k.items()) / sum(k.values()))
        assert np.allclose(level, weight * html_extract.smooth(np.log1p(ratio), weight))
        least = max(html_extract.FLOOR, html_extract.SHARE * np.std(level))
        assert html_extract.clusters(ratio, weight).tolist() == [bool(v >= least and r > 0) for v, r in zip(level, ratio, strict=True)]


def test_ratio_alone_on_a_page_without_names():
    page = f"<body><div><div><a href=1>Home</a> <a href=2>News</a></div><div>{BODY}</div><div><a href=3>Terms</a> <a href=4>Contact</a></div></div></body>"
    assert html_extract.main_text(page) == "\n".join(LONG)


def test_telling_names_inside_an_article():
    inner = f"<section id='discussion'><p>{LONG[1]}</p></section><p class='legal'>{LONG[2]}</p><ul><li><a href=1>A linked entry</a></li></ul><p>1 &lt; 2</p><p>&amp; <math><mi>x</mi></math></p>"
    assert html_extract.main_text(f"<body><article><h1>Title</h1><p>{LONG[0]}</p>{inner}</article></body>") == "\n".join(["Title", *LONG[:3], "A linked entry", "1 < 2", "& x"])
    assert html_extract.main_text(f"<body><article>{BODY}<section class='comments'><p>{LONG[1]}</p></section></article></body>") == "\n".join(LONG)


@pytest.mark.parametrize("page, text", [
    ("<p>one<!-- a > b --><p>two <!-- never closed <p>three", "one\ntwo"), ("<p>one <a href=x <p>two", "one two"), ("<p>one <a href=x two", "one"), ("<p>a < b & c</p>", "a < b & c"), ("<p title='it is \"so\" > x'>one</p>", "one"),
    ("<title>no</title><textarea><p>no</textarea><p>yes", "yes"), ("<p>one</p><![CDATA[x]]><?php x ?></><p>two", "one\ntwo"), ("<P>one<BR/>two</P >", "one two"), ("<p>it's<p a='b>c'>d", "it's\nd"),
    ("<style>p{}</style ><p>yes", "yes"), ("<p hidden>no</p><p>yes</p>", "yes"), ("<nav><p>only a menu</p></nav>", ""),
])
def test_broken_markup(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize("piece", ["<blockquote>", "<ul><li><span>", "<!--", "<a ", "<a href='", "<article>", "<p>a b c", "&", "<", "<!x", "<b>x", "<script>", "<a =", "&#x", "<table><tr><td><li>", "</p>", "<div class=ad>x", "<p x=\"", "<!-- x -->y", "</"])
def test_time_is_linear(piece):
    took = []
    for size in (100_000, 400_000):
        began = time.perf_counter()
        html_extract.main_text(piece * (size // len(piece)))
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 1


def test_documents_of_the_corpus_stay_clean(spark):
    rows, _ = corpus(60)
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.remove_contaminated(docs, bench).count() == 60
