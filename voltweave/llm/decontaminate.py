"""Benchmark decontamination with SQL functions only.

Words of benchmark items and documents are normalised alike.  Windows of
``WINDOW`` words of the items (the whole item where it is shorter) become hash
sets of at most ``SET_WINDOWS`` windows, cut by hash range; there is one unless the
benchmark is very large.  Each set is broadcast as a hash relation.  A document row
is tokenised once, its windows run as narrow (place, length, hash) entries past the
set within the task, and a hit is verified there by the words of the window.  The
text of a document is on no row but its own: only verified hits and one narrow row
per document are shuffled, whatever the size of the benchmark.

Edge cases: null and wordless texts have no words and no hits; items without
words are left out; items with a null id hit like others, but there is no id to
report; repeated rows and ids, null ids included, each keep their own result row;
ids of repeated items are reported once; an empty benchmark leaves every document
clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Words of a window.
WINDOW = 10
#: Windows of a broadcast set: a hash, the words as text and the item ids, about 200 bytes each, so some 60 MB.
SET_WINDOWS = 300_000
#: Digests of contaminated texts that may be broadcast (32 bytes each).
BROADCAST_DIGESTS = 500_000


def words_sql(text: str) -> str:
    """SQL of the array of normalised words of a column: A-Z lower-cased, other letters kept.

    lower() equals the A-Z mapping on ASCII texts and is several times faster there.  Splitting at what is no
    word is linear, while extracting all matches is not; it leaves an empty string at either end at most.
    """
    gap = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    t = f"coalesce(`{text}`, '')"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"array_remove(split(if(octet_length({t}) = char_length({t}), lower({t}), translate({t}, '{upper}', '{lower}')), '{gap}', -1), '')"


def benchmark_windows(benchmark: DataFrame, text: str = "text", key: str = "item_id", width: int = WINDOW) -> DataFrame:
    """(n, h, s, ids), one row per distinct window: its number of words, hash, words joined by a space (no word holds one) and sorted item ids."""
    own = benchmark.select(F.col(key).alias("item"), F.expr(words_sql(text)).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(width))
    own = own.select("item", n.alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))).alias("w"))
    own = own.select("item", "n", F.xxhash64("w").alias("h"), F.array_join("w", " ").alias("s"))
    return own.groupBy("n", "h", "s").agg(F.array_sort(F.collect_set("item")).alias("ids"))


def _sets(benchmark: DataFrame, width: int, set_windows: int) -> tuple[list[int], list[DataFrame]]:
    """Window lengths, at most ``width`` of them, and the sets of windows, none of more than about ``set_windows``; their union is all windows."""
    windows = settle(benchmark_windows(benchmark, width=width))
    count = {r.n: r["count"] for r in windows.groupBy("n").count().collect()}
    k = -(-sum(count.values()) // set_windows)
    if k <= 1:
        return sorted(count), [windows] * k
    return sorted(count), [windows.where(F.pmod("h", F.lit(k)) == i) for i in range(k)]


def _hits(rows: DataFrame, lengths: list[int], windows: DataFrame, how: str) -> DataFrame:
    """``rows`` (with the word array w) joined with the windows of one set that occur in them: place p, length n, and the set's s and ids.

    Exploding places, hashing, probing and comparing make one generated loop, which copies no words.  The words
    are compared within the probe, by array_contains because an equality would become part of the join's key.
    """
    each = rows.select("*", F.explode(F.array(*map(F.lit, lengths))).alias("n"))
    each = each.select("*", F.explode_outer(F.expr("if(size(w) >= n, sequence(1, size(w) - n + 1), null)")).alias("p"))
    each = each.withColumn("h", F.when(F.col("p").isNotNull(), F.xxhash64(F.slice("w", "p", "n"))))
    match = (each.h == windows.h) & F.expr("array_contains(array(s), array_join(slice(w, p, n), ' '))")
    # a set is bounded by SET_WINDOWS
    return each.join(F.broadcast(windows.select("h", "s", "ids")), match, how)


def scan(documents: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None, width: int = WINDOW, set_windows: int = SET_WINDOWS) -> DataFrame:
    """For every row: struct ``r`` of the narrow ``keep`` columns, ``n_words``, ``hits`` (sorted array of verified (p, n)) and ``items`` (ids)."""
    keep = ["doc_id"] if keep is None else keep
    lengths, sets = _sets(benchmark, width, set_windows)
    # rid numbers the rows of this one scan and only ties a row's own pieces together
    rows = documents.select(F.monotonically_increasing_id().alias("rid"), F.struct(*(F.col(f"`{c}`") for c in keep)).alias("r"), F.expr(words_sql(text)).alias("w"))
    if not sets:
        return rows.select("rid", "r", F.size("w").alias("n_words"), F.expr("cast(array() as array<struct<p:int,n:int>>)").alias("hits"), F.array().cast(f"array<{benchmark.schema['item_id'].dataType.simpleString()}>").alias("items"))
    if len(sets) > 1:  # each set passes over the same tokenised rows
        rows = settle(rows)
    found = None
    for i, windows in enumerate(sets):
        own = _hits(rows, lengths, windows, "inner" if i else "left")
        if not i:  # the first window of a row stands for the row
            own = own.where(F.col("s").isNotNull() | (F.coalesce("p", F.lit(1)) == 1) & (F.col("n") == lengths[0]))
        own = own.select("rid", F.when(F.lit(i == 0), F.col("r")).alias("r"), F.size("w").alias("n_words"), "ids", F.when(F.col("s").isNotNull(), F.struct("p", "n")).alias("hit"))
        found = own if found is None else found.unionByName(own)
    # collect_set leaves out the nulls of rows that hit nothing; equal id lists meet before they are laid open
    return found.groupBy("rid").agg(
        F.first("r", ignorenulls=True).alias("r"), F.first("n_words").alias("n_words"), F.array_sort(F.collect_set("hit")).alias("hits"), F.array_distinct(F.flatten(F.collect_set("ids"))).alias("items")
    )


def covered(hits: Column) -> Column:
    """Words inside any of the sorted (p, n) windows."""
    zero = F.struct(F.lit(0).alias("last"), F.lit(0).cast("bigint").alias("total"))

    def step(acc: Column, x: Column) -> Column:
        last = F.greatest(acc["last"], x["p"] + x["n"] - 1)
        return F.struct(last.alias("last"), (acc["total"] + last - F.least(last, F.greatest(acc["last"], x["p"] - 1))).cast("bigint").alias("total"))

    return F.aggregate(hits, zero, step, lambda acc: acc["total"])


def decontamination_query(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``op7``."""
    out = scan(documents, benchmark)
    n_hit = covered(F.col("hits"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return out.select(
        F.col("r.doc_id").alias("doc_id"), F.col("n_words").cast("bigint").alias("n_words"), n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256))


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, text: str = "text", width: int = WINDOW, set_windows: int = SET_WINDOWS) -> DataFrame:
    """The documents without those that hold a benchmark window; their columns stay as they are.

    Whether a document goes depends on its text alone, so the contaminated texts are found as SHA-256
    digests and taken out by an anti-join: ids may be null or repeated, and no text is on an exploded row.
    """
    lengths, sets = _sets(benchmark, width, set_windows)
    if not sets:
        return documents
    rows = documents.select(_digest(text).alias("k"), F.expr(words_sql(text)).alias("w"))
    found = None
    for windows in sets:
        own = _hits(rows, lengths, windows, "inner").select("k")
        found = own if found is None else found.union(own)
    dirty = settle(found.distinct())
    if dirty.count() <= BROADCAST_DIGESTS:
        dirty = F.broadcast(dirty)
    names = [f"c{i}" for i in range(len(documents.columns))]  # whatever the columns are called
    own = documents.select(_digest(text).alias("k"), *(F.col(f"`{c}`").alias(n) for n, c in zip(names, documents.columns, strict=True)))
    return own.join(dirty, "k", "left_anti").select(*(F.col(n).alias(c) for n, c in zip(names, documents.columns, strict=True)))


ORACLE_SQL = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0)
), doc AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), pos AS (
  SELECT rid, n, i, list_slice(w, i, i + n - 1) AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc CROSS JOIN (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hit AS (SELECT rid, item_id, i, pos.n FROM pos JOIN win ON pos.n = win.n AND pos.g = win.g),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)
"""
