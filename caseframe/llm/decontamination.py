"""Benchmark decontamination by a broadcast hash set of normalised test n-grams, in native expressions only.

What is broadcast are 64-bit fingerprints of the distinct item windows, as many bytes for a long word as for a short one. A scan of
the documents makes a fingerprint for every window of their words, one at a time (a row each inside one stage, never shuffled), and
keeps those that the set holds, with their words. These few are verified: a join by the words themselves, dealt over SALT parts
since one window may be in any share of the documents, drops what only has the fingerprint and brings the items. Then they are
grouped by document, with one row for each document.

BROADCAST bounds the fingerprints that are broadcast at once. A larger set takes a scan of the documents for each BROADCAST of them:
the same plan at every size, and texts are shuffled at none.

Words are runs of other than `[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing A-Z. Null and empty texts have none, on
either side. An item of fewer than WINDOW words is one window of them all. Items with equal texts occur together, item_ids
that repeat count once, and items without item_id are left out. Rows that repeat a doc_id are looked at one by one; rows without
doc_id give no result, and remove_contaminated() keeps them. Other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseframe.llm.common import Written, whole_texts

WINDOW = 10
#: Fingerprints that are broadcast at once: a long key each, at most 96 bytes in the hash table (192 MB).
BROADCAST = 2_000_000
SALT = 16
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, SEPARATORS), "")


def windows(of: Column, n: Column | int) -> Column:
    """All windows of n words, in order, each as its words joined by blanks."""
    n = F.lit(n) if isinstance(n, int) else n
    last = F.size(of) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(of, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, n (words of the window), window, and key, a fingerprint of its words."""
    items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", words(F.coalesce(F.col("text"), F.lit(""))).alias("words")).where(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(window))
    each = items.select("item_id", n.alias("n"), F.explode(windows(F.col("words"), n)).alias("window")).distinct()
    return each.withColumn("key", F.xxhash64(F.split("window", " ")))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = BROADCAST, key: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurrence), items (sorted item_ids as strings that occur), contaminated.

    `key` is applied to fingerprints (tests let many windows share one)."""
    coarse = (lambda x: x) if key is None else key
    items = item_windows(benchmark, window).withColumn("key", coarse(F.col("key")))
    known = Written(items.groupBy("n", "window", "key").agg(F.collect_set(F.col("item_id").cast("string")).alias("items")), "item-windows").df
    lengths = sorted(r["n"] for r in known.select("n").distinct().collect())  # at most `window` rows
    prints = known.select("key").distinct()
    blocks = -(-max(1, prints.count()) // most)

    texts = whole_texts(docs).select("doc_id", F.xxhash64("text", F.octet_length("text")).alias("print"), words(F.col("text")).alias("words"))
    # Place -1 is the document itself.
    places = texts.select("doc_id", "print", "words", F.size("words").alias("n_words"), F.explode(F.sequence(F.lit(-1), F.size("words") - 1)).alias("at"))
    first = (lengths or [window])[0]
    each = places.withColumn("n", F.explode(F.array(*map(F.lit, lengths or [window])))).where(F.when(F.col("at") < 0, F.col("n") == first).otherwise(F.col("at") + F.col("n") <= F.col("n_words")))
    own = F.slice("words", F.col("at") + 1, F.col("n"))
    each = each.withColumn("key", F.when(F.col("at") >= 0, coarse(F.xxhash64(own))))
    columns = ["doc_id", "print", "n_words", "at", "n", F.when(F.col("at") >= 0, F.array_join(own, " ")).alias("window")]
    sets = [prints.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).withColumn("in", F.lit(True)) for b in range(blocks)]
    met = each.join(F.broadcast(sets[0]), "key", "left").where((F.col("at") < 0) | F.col("in")).select(columns)
    for block in sets[1:]:
        met = met.unionByName(each.join(F.broadcast(block), "key").select(columns))
    met = Written(met, "met-windows").df

    salt = F.array(*map(F.lit, range(SALT)))
    dealt = met.where("at >= 0").withColumn("salt", F.pmod(F.xxhash64("doc_id", "at"), F.lit(SALT)).cast("int"))
    verified = dealt.join(known.select("window", "items", F.explode(salt).alias("salt")), ["window", "salt"])
    columns = ["doc_id", "print", "n_words", "at", "n"]
    hits = verified.select(*columns, "items").unionByName(met.where("at < 0").select(*columns, F.lit(None).cast("array<string>").alias("items")))

    covered = F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("at") >= 0, F.sequence("at", F.col("at") + F.col("n") - 1))))))
    found = hits.groupBy("doc_id", "print").agg(
        F.max("n_words").cast("long").alias("n_words"), covered.cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.count_if(F.col("at") < 0).alias("rows")
    )
    rows = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))  # rows of one doc_id and text
    return rows.select("doc_id", "n_words", "n_hit", "items", (F.col("n_hit") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, with all their columns, that hold no benchmark window."""
    bad = scan(docs, benchmark, window).where("contaminated").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS win
  FROM b, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS r(i) WHERE len(ws) > 0),
dw AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (win)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, list(item ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
