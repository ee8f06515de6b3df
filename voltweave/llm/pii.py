"""Personal data: base patterns plus candidates selected by boosted trees, all in SQL functions.

Base spans follow fixed patterns and checks and always stay.  High-recall
generators then propose further spans, which may overlap: digit runs and groups with
any usual separator, phone-like groups with or without a plus sign, address-like
quads, mail addresses and addresses with spelt-out or bracketed signs, and long
mixed strings that may be credentials.  Each candidate has a vector of small integers
about its format (digits, checksum, signs, length, spelling) and its context
(neighbouring characters, an assignment or a telling word before it).

Gradient-boosted trees are fitted on a bounded sample of documents.  No labels say
what is personal, so examples are made: candidates on and off base spans, and base
spans rewritten within their context, as people disguise them (other separators,
no plus sign, spelt-out signs: still personal data) and as they are not (a broken
checksum, a part out of range, a version or order number).  A string is an example of a
credential if a word such as token or password is set to it.  Equal vectors are counted
together by a grouped aggregate, so that fitting sees a small table.  The trees
become one SQL expression.  A candidate at or above its kind's threshold (the lowest
score that keeps the wanted precision on the half of the sample that was not fitted)
is added unless it overlaps a base span or a better candidate.

Texts with very many spans: places are summed in blocks, and overlaps are looked for in
the blocks that can hold some, so that work is about the number of spans to the power 1.5.

Edge cases: null counts as empty and has no spans; ties between candidates go to
the earlier, then to the order of ``KINDS``; repeated rows are treated one by
one; a sample without candidates adds nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of the digests; base patterns know the first four.
KINDS = ("email", "ip", "card", "phone", "secret")
N_BASE = 4
#: Bound of the documents that candidates are fitted on, of the spans of each that are rewritten, and characters of context around them.
TRAIN_DOCS, TRAIN_SPANS, CONTEXT = 20_000, 20, 40
#: Share of true candidates wanted among those that are added.
PRECISION = 0.97
#: Trees, their depth and the learning rate.
ROUNDS, DEPTH, RATE = 32, 4, 0.3
#: Spans of a block, and characters of one when a text is put together again.
BLOCK, PIECE = 256, 4096

# The base patterns.  Possessive repeats and the \G anchors change no match: they keep
# long runs from being tried again from each of their characters.
_BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(t, '@')"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", "contains(t, '.')"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "t rlike '[0-9]'"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "contains(t, '+')"),
}
_SPELT = r"(?:\x20?[\[({]\x20?(?:dot|DOT)\x20?[\])}]\x20?|\x20(?:dot|DOT)\x20)"
_AT, _DOT = r"(?:@|\x20?[\[({]\x20?(?:at|AT|@)\x20?[\])}]\x20?|\x20(?:at|AT)\x20(?=[A-Za-z0-9-]+\x20?[\[({\x20]\x20?(?:dot|DOT)))", rf"(?:\.|\x20?[\[({{]\x20?\.\x20?[\])}}]\x20?|{_SPELT})"
# Generators: kind, pattern, cheap guard.
_GENERATORS = (
    ("card", r"[0-9]{12,19}", "t rlike '[0-9]{12}'"),
    ("card", r"[0-9]{4}(?:[\x20._/-]{1,2}[0-9]{4}){2}[\x20._/-]{1,2}[0-9]{1,7}", "t rlike '[0-9]{4}[ ._/-]{1,2}[0-9]{4}'"),
    ("phone", r"(?:\+|00)?[0-9]{0,3}[\x20./-]?\(?[0-9]{3}\)?[\x20./-]?[0-9]{3}[\x20./-]?[0-9]{4}", "t rlike '[0-9]{4}'"),
    ("ip", r"[0-9]{1,3}(?:(?:\.|\x20?[\[({]\x20?(?:\.|dot)\x20?[\])}]\x20?|\x20\.\x20)[0-9]{1,3}){3}", "t rlike '[.]|dot'"),
    ("email", rf"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:{_SPELT}[A-Za-z0-9._%+-]++){{0,3}}{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++", "t rlike '@|[Aa][Tt]'"),
    ("secret", r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{16,}+={0,2}", "t rlike '[A-Za-z0-9_+/-]{16}'"),
)
#: Order of the feature vector.
FEATURES = ("generator", "digits", "checksum", "octets", "plus", "paren", "signs", "length", "before", "after", "assigned", "groups", "spelt", "word", "mixed")
#: Telling words before a candidate.
_WORDS = ("tel|phone|call|fax|mobile|dial|ring", "mail|contact|write", "card|visa|credit|cc", "addr|host|server|ip|ping", "token|key|secret|passw|pwd|auth|bearer|credential", "version|order|invoice|release|no|id")
_NAMED = "(?i)(?:token|key|secret|passw[a-z]*|pwd|auth|bearer|credential[s]?)[\\x22\\x27]?\\x20*[=:]\\x20*[\\x22\\x27]?$"


def _text(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL of ``body`` with ``name`` bound to ``value``, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


_SPAN = "array<struct<s:int,e:int,x:string,l:string,a:string>>"


def _blocks(array: str, size: int = BLOCK) -> str:
    """SQL of an array in slices; none for an empty array."""
    return f"if(size({array}) = 0, slice(array({array}), 1, 0), transform(sequence(0, (size({array}) - 1) div {size}), k -> slice({array}, cast(k as int) * {size} + 1, {size})))"


def _sums(lengths: str) -> str:
    """SQL of the running sums of an int array: within slices, then of the slices."""
    scan = "aggregate({x}, cast(array() as array<int>), (a, v) -> array_append(a, v + if(size(a) = 0, 0, a[size(a) - 1])))"
    whole = _let("o", scan.format(x="transform(n, y -> y[size(y) - 1])"), "flatten(transform(n, (y, k) -> transform(y, v -> v + if(k = 0, 0, o[k - 1]))))")
    return _let("g", lengths, _let("n", f"transform({_blocks('g')}, z -> {scan.format(x='z')})", whole))


def _matches(pattern: str, guard: str) -> str:
    """SQL of the array of (s, e, x, l, a) of the matches in t: code points, end exclusive, the text, and some text before and after it.

    Splitting at the pattern gives the stretches between its matches, and so their places.
    """
    rx = _text(pattern)
    before = "if(length(p[i]) > 0, right(p[i], 24), if(i = 0, '', right(q[i - 1], 1)))"
    after = "if(length(p[i + 1]) > 0, left(p[i + 1], 1), if(i + 1 < size(q), left(q[i + 1], 1), ''))"
    made = f"transform(q, (x, i) -> named_struct('s', u[i] - length(x), 'e', u[i], 'x', x, 'l', {before}, 'a', {after}))"
    found = _let("q", f"regexp_extract_all(t, {rx}, 0)", f"if(size(q) = 0, cast(array() as {_SPAN}), {_let('p', f'split(t, {rx}, -1)', _let('u', _sums('transform(q, (x, i) -> length(p[i]) + length(x))'), made))})")
    return f"if({guard}, {found}, cast(array() as {_SPAN}))"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(d: str) -> str:
    """SQL: the checksum of the digit string d holds; not without digits or with over 40 of them."""
    digit = f"cast(substring({d}, -k, 1) as int)"
    return f"if(length({d}) = 0 or length({d}) > 40, false, aggregate(sequence(1, greatest(length({d}), 1)), 0, (a, k) -> a + if(k % 2 = 1, {digit}, 2 * {digit} - if({digit} > 4, 9, 0))) % 10 = 0)"


_OCTETS = "forall(split({x}, '[^0-9]+'), o -> length(ltrim('0', o)) <= 3 and cast(concat('0', ltrim('0', o)) as bigint) <= 255)"


def _valid(kind: str) -> str:
    """SQL of the check of a base match m."""
    if kind == "email":
        return "true"
    if kind == "ip":
        return _OCTETS.format(x="m.x")
    if kind == "card":
        return _let("d", _digits("m.x"), f"length(d) between 12 and 19 and {_luhn('d')}")
    return f"length({_digits('m.x')}) between 9 and 15"


def _base() -> str:
    """SQL of the base spans of t: array of (s, r, e), r the place of the kind in ``KINDS``, in order."""
    each = [f"transform(filter({_matches(*_BASE[k])}, m -> {_valid(k)}), m -> named_struct('s', m.s, 'r', {r}, 'e', m.e))" for r, k in enumerate(KINDS[:N_BASE])]
    return f"array_sort(concat({', '.join(each)}))"


def _candidates() -> str:
    """SQL of the candidates of t: array of (s, r, e, f, named), f the feature vector, named whether a credential's name stands before it."""
    side = "case when {c} = '' then 0 when {c} rlike '[0-9]' then 3 when {c} rlike '[\\\\p{{L}}_]' then 2 when {c} rlike '\\\\s' then 0 else 1 end"
    word = "case " + " ".join(f"when m.l rlike '(?i)(?<![a-z])(?:{w})[a-z]*[^a-z0-9]{{0,6}}$' then {i + 1}" for i, w in enumerate(_WORDS)) + " else 0 end"
    out = []
    for g, (kind, pattern, guard) in enumerate(_GENERATORS):
        vector = ", ".join([
            str(g), "least(length(d), 20)", f"cast({_luhn('d')} as int)" if kind == "card" else "0",
            f"cast({_OCTETS.format(x='m.x')} as int)" if kind == "ip" else "0",
            "cast(contains(m.x, '+') as int)", "cast(contains(m.x, '(') as int)",
            "least(length(regexp_replace(m.x, '[A-Za-z0-9]', '')), 8)", "least(cast(length(m.x) / 2 as int), 15)",
            side.format(c="right(m.l, 1)"), side.format(c="m.a"), "cast(right(m.l, 12) rlike '[=\"]' as int)",
            "least(size(split(m.x, '[^0-9]+')), 8)", "cast(m.x rlike '(?i)[^a-z0-9](?:at|dot)[^a-z0-9]' as int)", word,
            "cast(m.x rlike '[0-9]' as int) + cast(m.x rlike '[a-z]' as int) + cast(m.x rlike '[A-Z]' as int)",
        ])
        vector = f"cast(array({vector}) as array<int>)"
        named = f"m.l rlike {_text(_NAMED)}" if kind == "secret" else "false"
        out.append(f"transform({_matches(pattern, guard)}, m -> named_struct('s', m.s, 'r', {KINDS.index(kind)}, 'e', m.e, 'f', {_let('d', _digits('m.x'), vector)}, 'named', {named}))")
    return f"concat({', '.join(out)})"


def _variants() -> str:
    """SQL of the rewritten forms of a base span c (kind c.r, text c.x): array of (x, yes)."""
    d = _digits("c.x")
    grouped = lambda d, sign: f"regexp_replace({d}, '([0-9]{{4}})(?=[0-9])', '$1{sign}')"
    broken = f"concat(left({d}, length({d}) - 1), cast((cast(right({d}, 1) as int) + 1) % 10 as string))"
    forms = {
        "email": [(f"replace(replace(c.x, '@', '{at}'), '.', '{dot}')", True) for at, dot in ((" [at] ", "."), ("(at)", "."), (" (at) ", "."), ("(at)", " [dot] "), (" at ", " dot "), ("{at}", "(dot)"), (" (AT) ", " (DOT) "))],
        "ip": [(f"replace(c.x, '.', '{dot}')", True) for dot in ("[.]", " . ", " (dot) ", "[dot]")] + [("regexp_replace(c.x, '^[0-9]+', '999')", False), ("regexp_replace(c.x, '[0-9]+$', '402')", False), ("concat('version ', c.x)", False)],
        "card": [(grouped(d, sign), True) for sign in (" ", "-", ".", "/", "_", "  ")] + [(grouped(broken, sign), False) for sign in ("", " ", "-", ".")],
        "phone": [("replace(c.x, '+', '')", True), ("replace(c.x, '+', '00')", True), ("regexp_replace(c.x, '[ ()-]+', '.')", True), ("regexp_replace(regexp_replace(c.x, '[()+]', ''), ' ', '/')", True), ("regexp_replace(regexp_replace(c.x, '[()+]', ''), '[ ]', '-')", True), (f"concat('order ', {d})", False), (f"concat('id=', {d})", False)],
    }
    for own in forms.values():
        own.append(("c.x", True))
    array = lambda own: "array(" + ", ".join(f"named_struct('x', {x}, 'yes', {str(yes).lower()})" for x, yes in own) + ")"
    return "case c.r " + " ".join(f"when {KINDS.index(k)} then {array(own)}" for k, own in forms.items()) + " end"


@dataclass
class Model:
    """Trees as nested (feature, cut, low branch, high branch) or leaf values, and a threshold for each kind."""

    trees: list = field(default_factory=list)
    bias: float = -20.0
    thresholds: dict[int, float] = field(default_factory=dict)

    def sql(self, f: str) -> str:
        """SQL of the score of a feature vector."""

        def tree(t) -> str:
            return f"{t!r}D" if isinstance(t, float) else f"if({f}[{t[0]}] <= {t[1]}, {tree(t[2])}, {tree(t[3])})"

        return " + ".join([f"{self.bias!r}D", *map(tree, self.trees)])


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """Regression tree on gradient sums; rows are cells with summed gradients and curvatures."""
    gain = lambda a, b: a * a / (b + 1.0)
    best = (1e-6, None, None)
    if depth:
        whole = gain(g.sum(), h.sum())
        for j in range(x.shape[1]):
            for at in np.unique(x[:, j])[:-1]:
                low = x[:, j] <= at
                won = gain(g[low].sum(), h[low].sum()) + gain(g[~low].sum(), h[~low].sum()) - whole
                if won > best[0]:
                    best = (won, j, int(at))
    if best[1] is None:
        return float(-RATE * g.sum() / (h.sum() + 1.0))
    low = x[:, best[1]] <= best[2]
    return (best[1], best[2], _grow(x[low], g[low], h[low], depth - 1), _grow(x[~low], g[~low], h[~low], depth - 1))


def _apply(t, x: np.ndarray) -> np.ndarray:
    return np.full(len(x), t) if isinstance(t, float) else np.where(x[:, t[0]] <= t[1], _apply(t[2], x), _apply(t[3], x))


def fit(x: np.ndarray, kind: np.ndarray, true: np.ndarray, false: np.ndarray, held_true: np.ndarray, held_false: np.ndarray) -> Model:
    """Boosted trees on cells (equal vectors) with counts of true and false examples; thresholds from the held counts."""
    n, p = true + false, true.sum()
    if not p or not n.sum():
        return Model()
    model = Model(bias=float(np.log(max(p, 0.5) / max(n.sum() - p, 0.5))))
    s = np.full(len(x), model.bias)
    for _ in range(ROUNDS):
        q = 1 / (1 + np.exp(-s))
        t = _grow(x, n * q - true, n * q * (1 - q), DEPTH)
        model.trees.append(t)
        s += _apply(t, x)
    for r in np.unique(kind).tolist():
        own = kind == r
        order = np.argsort(-s[own], kind="stable")
        level, good, bad = s[own][order], np.cumsum(held_true[own][order]), np.cumsum(held_false[own][order])
        last = np.append(level[1:] != level[:-1], True)  # a threshold takes all of a level
        fine = last & (good >= PRECISION * (good + bad)) & (good > 0) & (level > 0)
        if fine.any():
            at = np.flatnonzero(fine)[-1]  # half way to the next level, which does not keep the precision, or to even odds
            model.thresholds[r] = float(level[at] + max(0.0, level[at + 1] if at + 1 < len(level) else 0.0)) / 2
    return model


def examples(some: DataFrame, text: str, key: str) -> DataFrame:
    """(held, r, f, yes) of every example that the documents of a sample give."""
    held = F.pmod(F.xxhash64(F.col(key), F.lit(31)), F.lit(2)).alias("held")
    whole = f"coalesce(`{text}`, '')"
    agrees = "exists(b, y -> y.r = c.r and y.s <= c.s and c.e <= y.e and c.e - c.s >= 0.8 * (y.e - y.s))"
    touches = "exists(b, y -> y.r = c.r and y.s < c.e and c.s < y.e)"
    yes = f"if(c.r = {N_BASE}, c.named, {agrees})"
    # examples are made within the row, so that exploding copies nothing but them; a piece of a longer base span teaches nothing
    plain = f"transform(filter({_candidates()}, c -> c.r = {N_BASE} or {agrees} or not {touches}), c -> named_struct('r', c.r, 'f', c.f, 'yes', {yes}))"
    found = some.select(held, F.explode(F.expr(_let("t", whole, _let("b", f"slice({_base()}, 1, {BLOCK})", plain)))).alias("c"))
    # each rewritten span stands in a short text of its own, between the characters that were around it
    each = some.select(held, F.explode(F.expr(_let("t", whole, f"transform(slice({_base()}, 1, {TRAIN_SPANS}), y -> named_struct('r', y.r, 'x', substring(t, y.s + 1, y.e - y.s), 'l', substring(t, greatest(y.s - {CONTEXT}, 0) + 1, least(y.s, {CONTEXT})), 'a', substring(t, y.e + 1, {CONTEXT})))"))).alias("c"))
    each = each.select("held", "c", F.explode(F.expr(_variants())).alias("v"))
    # and once more between single characters, so that no word around a value is all there is to it
    bare = "named_struct('r', c.r, 'x', c.x, 'l', right(c.l, 1), 'a', left(c.a, 1))"
    each = each.select("held", "v", F.explode(F.expr(f"array(c, {bare})")).alias("c"))
    on = "transform(filter(z, y -> y.r = c.r and y.s < length(c.l) + length(v.x) and length(c.l) < y.e and (not v.yes or y.e - y.s >= 0.9 * length(v.x))), y -> named_struct('r', y.r, 'f', y.f, 'yes', v.yes))"
    made = each.select("held", F.explode(F.expr(_let("t", "concat(c.l, v.x, c.a)", _let("z", _candidates(), on)))).alias("c"))
    return found.unionByName(made).select("held", F.col("c.r").alias("r"), F.col("c.f").alias("f"), F.col("c.yes").alias("yes"))


def train(documents: DataFrame, text: str = "text", key: str = "doc_id", train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on the candidates of at most about ``train_docs`` documents, chosen by a hash of the id."""
    total = documents.count()
    if not total:
        return Model()
    span = 1 << 30
    some = documents.where(F.pmod(F.xxhash64(F.col(key), F.lit(29)), F.lit(span)) < min(span, span * train_docs // total + 1))
    cells = examples(some, text, key).groupBy("held", "r", "f", "yes").agg(F.count("*").alias("n")).collect()
    keys = sorted({(c.r, tuple(c.f)) for c in cells})
    if not keys:
        return Model()
    at = {k: i for i, k in enumerate(keys)}
    count = np.zeros((2, 2, len(keys)))
    for c in cells:
        count[c.held, int(c.yes), at[c.r, tuple(c.f)]] += c.n
    return fit(np.array([k[1] for k in keys]), np.array([k[0] for k in keys]), count[0, 1], count[0, 0], count[1, 1], count[1, 0])


def _reach(spans: str) -> str:
    """SQL of sorted spans in blocks with the least start and the greatest end of each."""
    return f"transform({_blocks(spans)}, z -> named_struct('s', z[0].s, 'e', array_max(transform(z, y -> y.e)), 'own', z))"


def _overlap(blocks: str, c: str, more: str = "true") -> str:
    """SQL: some span y of the blocks overlaps span c and has ``more``."""
    return f"exists({blocks}, w -> w.s < {c}.e and {c}.s < w.e and exists(w.own, y -> y.s < {c}.e and {c}.s < y.e and {more}))"


def _added(model: Model) -> str:
    """SQL of the added spans of t: array of (s, r, e), given the base spans b."""
    kinds = [(r, v) for r, v in sorted(model.thresholds.items())]
    if not kinds:
        return "cast(array() as array<struct<s:int,r:int,e:int>>)"
    limit = "case " + " ".join(f"when c.r = {r} then {v!r}D" for r, v in kinds) + " else 1e300D end"
    scored = f"transform({_candidates()}, c -> named_struct('s', c.s, 'r', c.r, 'e', c.e, 'neg', -({model.sql('c.f')})))"
    good = f"array_sort(filter({scored}, c -> -c.neg >= {limit} and not {_overlap('h', 'c')}))"
    better = "named_struct('neg', y.neg, 's', y.s, 'r', y.r, 'e', y.e) < named_struct('neg', c.neg, 's', c.s, 'r', c.r, 'e', c.e)"
    kept = _let("g", good, _let("j", _reach("g"), f"transform(filter(g, c -> not {_overlap('j', 'c', better)}), c -> named_struct('s', c.s, 'r', c.r, 'e', c.e))"))
    return _let("h", _reach("b"), kept)


def _found(model: Model, text: str) -> str:
    """SQL of struct (base, spans) of a text column: base spans and all spans, each sorted."""
    inner = _let("b", _base(), f"named_struct('base', b, 'spans', array_sort(concat(b, {_added(model)})))")
    return _let("t", f"coalesce(`{text}`, '')", inner)


def _name(y: str, names: Sequence[str]) -> str:
    return f"case {y}.r " + " ".join(f"when {r} then '{k}'" for r, k in enumerate(names)) + " end"


def _digest(spans: str) -> str:
    return f"array_join(transform({spans}, y -> concat({_name('y', KINDS)}, ':', y.s, ':', y.e)), ',')"


def pii_query(documents: DataFrame) -> DataFrame:
    """``op5``: counts and digest of the base spans, all spans and their number."""
    model = train(documents)
    out = documents.select("doc_id", F.expr(_found(model, "text")).alias("f"))
    counts = [F.expr(f"cast(size(filter(f.base, y -> y.r = {r})) as bigint)").alias(f"n_{k}") for r, k in enumerate(KINDS[:N_BASE])]
    return out.select("doc_id", *counts, F.expr(f"sha2(cast({_digest('f.base')} as binary), 256)").alias("base_sha256"), F.expr(_digest("f.spans")).alias("spans"), F.expr("cast(size(f.spans) as bigint)").alias("n_spans"))


def redact(documents: DataFrame, model: Model, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; a null text stays null.

    ``length``, if the column exists, gets the new number of code points.  Overlapping spans become one mark, of
    the first of them.  The text is put together from pieces of ``PIECE`` characters, each from its own spans.
    """
    own = "flatten(transform(filter(h, w -> w.s < k + {n} and k < w.e), w -> filter(w.own, y -> y.s < k + {n} and k < y.e)))".format(n=PIECE)
    # a span that an earlier one overlaps has no mark of its own, nor has one that began in an earlier piece
    step = f"(a, y) -> if(y.e <= a.at, a, named_struct('at', y.e, 'out', concat(a.out, if(y.s > a.at, substring(c, a.at - k + 1, y.s - a.at), ''), if(y.s < a.at or y.s < k, '', {_name('y', [f'<{x.upper()}>' for x in KINDS])}))))"
    piece = f"aggregate({own}, named_struct('at', k, 'out', ''), {step}, a -> concat(a.out, if(a.at < k + {PIECE}, substring(c, a.at - k + 1), '')))"
    whole = f"array_join(transform(transform(sequence(0, length(t) - 1, {PIECE}), k -> named_struct('k', k, 'c', substring(t, k + 1, {PIECE}))), z -> {_let('k', 'z.k', _let('c', 'z.c', piece))}), '')"
    made = _let("t", f"`{text}`", _let("f", _found(model, text), f"if(size(f.spans) = 0, t, {_let('h', _reach('f.spans'), whole)})"))
    out = documents.withColumn(text, F.expr(f"if(`{text}` is null, null, {made})"))
    if length in documents.columns:
        out = out.withColumn(length, F.when(F.col(text).isNull(), F.col(length)).otherwise(F.length(text)).cast(documents.schema[length].dataType))
    return out
