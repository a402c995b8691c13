"""Divergence of sources: how far term frequencies of each (lang, source) group are from its peers' and its language's, exactly.

Terms are runs of A-Z, a-z and characters beyond ASCII, with A-Z lower-cased. A language keeps the V terms that at least DOCUMENTS of
its documents hold. With N the count of a group's (or language's) kept terms together, p = 1 + floor(10^9 (count + 2) / (N + 2 V)),
and two frequencies diverge by floor((p - q)^2 / (p + q)), all in integers.

1. Tasks count terms of their documents by group; Spark adds the counts up by (lang, source, term) and by (lang, term).
2. Kept terms are dealt into chunks of about `width` terms by a hash, groups into blocks of `size` by their number in the language.
   A unit is what a block's groups count in one chunk, as one compressed vector: at most CELLS counts, whatever the corpus.
3. Units meet in a round-robin tournament. In round r block i stays where it is and block (r - i) mod B travels to it; over B rounds
   every two blocks of a language meet once, and a block meets itself. Units are shuffled to their places once: each round reuses that
   exchange, and only travellers move. A meeting evaluates both directions (the divergence is symmetric) of every two groups, sparse
   counts against sparse counts; sums over chunks are added up by Spark. Rounds are ROUNDS at most, since `size` grows with the groups.
4. Each unit also meets its language's vector of the chunk: a heap of `top` terms for each group, merged over chunks by rank.

Null text, lang and source count as ''. Every row is a document, whatever its doc_id; repeated rows count each. Groups without terms
have N = 0 and take part; languages without kept terms have V = 0, pairs of value 0 and no terms. A language with one source has no
pairs. Equal values are ranked by the item's UTF-8 bytes. Other columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from caseframe.llm.common import Written, drop_all, numbered, tidy

DOCUMENTS = 10
TOP = 10
SCALE = 10**9
#: Groups of a block at least, terms of a chunk at most, counts of a unit at most (about), rounds at most.
BLOCK, WIDTH, CELLS, ROUNDS = 8, 8_192, 1 << 20, 32
#: Bytes of one text that are split into terms at once, and distinct counts that a task holds before it passes them on.
PIECE, HELD = 1 << 22, 300_000

_TERMS = re.compile(rb"[a-z\x80-\xff]+")
_BETWEEN = re.compile(rb"[^a-z\x80-\xff]")


def _pieces(text: bytes) -> Iterator[bytes]:
    """Parts of a text, cut between terms."""
    at = 0
    while at < len(text):
        cut = _BETWEEN.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


@tidy
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs: counts of this task's documents, passed on when many."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> pa.RecordBatch:
        keys = [(lang, source, term, n, docs[term]) for (lang, source), (counts, docs) in held.items() for term, n in counts.items()]
        lang, source, term, n, docs = zip(*keys, strict=True) if keys else ((),) * 5
        terms = pa.array(term, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), terms, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])

    size = 0
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
            texts = batch.column("text")
            for i, group in enumerate(groups):
                counts, docs = held.setdefault(group, (Counter(), Counter()))
                before, seen = len(counts), set()
                for piece in _pieces(texts[i].as_buffer().to_pybytes().lower()):
                    terms = _TERMS.findall(piece)
                    counts.update(terms)
                    seen.update(terms)
                docs.update(seen)
                size += len(counts) - before
                if size > HELD:
                    yield out()
                    held.clear()
                    size = 0
    if size:
        yield out()


def frequency(count: np.ndarray, n: int, v: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (n + 2 v)), exactly: three digits of the quotient at a time, so that longs suffice."""
    rest, whole, quotient = np.asarray(count, np.int64) + 2, np.int64(n + 2 * v), np.zeros(np.shape(count), np.int64)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, whole)
        quotient = quotient * 1000 + digits
    return quotient + 1


def diverge(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


# ---------------------------------------------------------------------------------------------------------------
# units


def pack(row: np.ndarray, term: np.ndarray, n: np.ndarray) -> bytes:
    """Counts by row and term, compressed: places as differences, counts in as few bytes as the largest takes."""
    order = np.lexsort((term, row))
    row, term, n = row[order], term[order], n[order]
    step = np.diff(row * (1 << 32) + term, prepend=0)
    kind = np.min_scalar_type(int(n.max())) if len(n) else np.dtype("u1")
    return zlib.compress(bytes([kind.itemsize]) + np.int64(len(n)).tobytes() + step.astype("<i8").tobytes() + n.astype(f"<u{kind.itemsize}").tobytes(), 1)


def unpack(blob: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not blob:
        return (np.empty(0, np.int64),) * 3
    data = zlib.decompress(blob)
    many = int(np.frombuffer(data, "<i8", 1, 1)[0])
    place = np.cumsum(np.frombuffer(data, "<i8", many, 9))
    n = np.frombuffer(data, f"<u{data[0]}", many, 9 + 8 * many).astype(np.int64)
    return place >> 32, place & 0xFFFFFFFF, n


class Unit:
    """The groups of a block in one chunk: numbers, kept terms of all chunks together, and frequencies where they count something."""

    def __init__(self, roster: list[dict], blob: bytes | None, v: int):
        self.no = np.array([g["no"] for g in roster], np.int64)
        self.total = np.array([g["n"] for g in roster], np.int64)
        self.row, self.term, self.n = unpack(blob)
        self.starts = np.searchsorted(self.row, np.arange(len(self.no) + 1))
        some = v > 0
        self.none = np.array([int(frequency(0, int(t), v)) if some else 1 for t in self.total], np.int64)
        self.p = np.concatenate([np.empty(0, np.int64), *(frequency(self.n[a:b], int(t), v) for a, b, t in zip(self.starts[:-1], self.starts[1:], self.total, strict=True))])

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum of values over each group's counts."""
        before = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
        return before[self.starts[1:]] - before[self.starts[:-1]]


def meet(one: Unit, other: Unit, width: int) -> np.ndarray:
    """The divergence of each group of `one` from each of `other`, summed over the chunk's `width` terms."""
    out = np.empty((len(one.no), len(other.no)), np.int64)
    dense, mask = np.empty(width, np.int64), np.zeros(width, bool)
    counts = np.diff(other.starts)
    q_none = other.none[other.row]
    for a in range(len(one.no)):
        at = slice(one.starts[a], one.starts[a + 1])
        mine, p = one.term[at], one.p[at]
        dense.fill(one.none[a])
        dense[mine] = p
        mask[mine] = True
        both = mask[other.term]
        here = dense[other.term]
        value = other.sums(diverge(here, other.p) - np.where(both, diverge(here, q_none), 0))
        for q in np.unique(other.none).tolist():  # terms that only one of them, and neither, counts
            those = other.none == q
            value[those] += diverge(p, np.int64(q)).sum() + (width - len(mine) - counts[those] + other.sums(both.astype(np.int64))[those]) * diverge(one.none[a], np.int64(q))
        out[a] = value
        mask[mine] = False
    return out


@tidy
def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            one = Unit(row["roster"], row["counts"], row["v"])
            self_meeting = row["block"] == row["other_block"]
            other = one if self_meeting else Unit(row["other_roster"], row["other_counts"], row["v"])
            value = meet(one, other, row["width"])
            a, b = np.triu_indices(len(one.no), 1) if self_meeting else map(np.ravel, np.indices(value.shape))
            yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(a), pa.string()), pa.array(one.no[a]), pa.array(other.no[b]), pa.array(value[a, b])], ["lang", "a", "b", "value"])


def _ranker(top: int):
    @tidy
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The `top` terms of each group that are more frequent there than in its language, by divergence and then by term."""
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                unit = Unit(row["roster"], row["counts"], row["v"])
                terms = row["terms"].split("\n")
                q = frequency(np.array(row["totals"], np.int64), row["lang_n"], row["v"])
                for g, no in enumerate(unit.no.tolist()):
                    at = slice(unit.starts[g], unit.starts[g + 1])
                    term, p = unit.term[at], unit.p[at]
                    value = np.where(p > q[term], diverge(p, q[term]), -1)
                    heap = heapq.nsmallest(top, zip((-value).tolist(), term.tolist(), strict=True))  # chunks list terms by their bytes
                    best = [(-v, terms[t]) for v, t in heap if v <= 0]
                    yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(best), pa.string()), pa.array([no] * len(best), pa.int64()), pa.array([t for _, t in best], pa.string()), pa.array([v for v, _ in best], pa.int64())], ["lang", "no", "term", "value"])

    return rank


def _pack_unit(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(batches)
    blob = pack(*(rows.column(c).to_numpy() for c in ("row", "idx", "n")))
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.int32()), pa.array([key[2].as_py()], pa.int64()), pa.array([blob], pa.binary())], ["lang", "chunk", "block", "counts"])


# ---------------------------------------------------------------------------------------------------------------


def audit(docs: DataFrame, documents: int = DOCUMENTS, top: int = TOP, block: int = BLOCK, width: int = WIDTH) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank."""
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = Written(named.mapInArrow(_count, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    kept = Written(counts.df.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= documents).select("lang", "term", "total"), "kept-terms")
    languages = kept.df.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))

    # Groups, numbered in their language; their size and the chunks' width follow the largest language.
    groups = named.select("lang", "source").distinct()
    roster = Written(numbered(groups, ["lang"], "source", "no", rows=1, buckets=64, few_groups=False), "group-numbers")
    most = (roster.df.agg(F.max("no")).first()[0] or 0) + 1
    block = max(block, -(-most // ROUNDS))
    width = min(width, max(64, CELLS // block))
    numbers = roster.df.withColumn("block", F.floor(F.col("no") / block))

    # Chunks of kept terms; a term's place in its chunk is the order of its bytes.
    chunk = F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / width)).cast("int")
    # Written first, so that the ranks below are dealt by chunk and not, like the join, by language.
    dealt = Written(kept.df.join(languages, "lang").withColumn("chunk", chunk), "dealt-terms")
    indexed = Written(dealt.df.withColumn("idx", (F.row_number().over(W.partitionBy("lang", "chunk").orderBy("term")) - 1).cast("long")), "chunks")
    entries = Written(counts.df.join(indexed.df.select("lang", "term", "chunk", "idx"), ["lang", "term"]).join(numbers, ["lang", "source"]).select("lang", "chunk", "block", "no", "idx", "n"), "entries")
    packed = entries.df.select("lang", "chunk", "block", (F.col("no") - F.col("block") * block).alias("row"), "idx", "n").groupBy("lang", "chunk", "block").applyInArrow(_pack_unit, "lang string, chunk int, block long, counts binary")
    totals = entries.df.groupBy("lang", "no").agg(F.sum("n").alias("n"))
    rosters = numbers.join(totals, ["lang", "no"], "left").groupBy("lang", "block").agg(F.array_sort(F.collect_list(F.struct("no", F.coalesce("n", F.lit(0)).alias("n")))).alias("roster"))
    vectors = indexed.df.groupBy("lang", "chunk").agg(F.array_sort(F.collect_list(F.struct("idx", "term", "total"))).alias("all"))
    vectors = vectors.select("lang", "chunk", F.size("all").cast("long").alias("width"), F.array_join("all.term", "\n").alias("terms"), F.col("all.total").alias("totals"))
    blocks = roster.df.groupBy("lang").agg((F.floor(F.max("no") / block) + 1).alias("blocks"))
    sizes = vectors.select("lang", "chunk", "width")
    chunks = blocks.join(languages, "lang", "left").join(sizes, "lang", "left")
    chunks = chunks.select("lang", "blocks", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("v", "lang_n", "chunk", "width")))
    units = Written(chunks.join(rosters, "lang").join(packed, ["lang", "chunk", "block"], "left"), "units")

    rounds = -(-most // block)
    staying = units.df.select("lang", "chunk", "block", "blocks", "v", "width", "roster", "counts")
    met = None
    for r in range(rounds):
        place = F.pmod(F.lit(r) - F.col("block"), F.col("blocks"))
        travelling = units.df.where((F.col("blocks") > r) & (place <= F.col("block"))).select("lang", "chunk", place.alias("block"), F.col("block").alias("other_block"), F.col("roster").alias("other_roster"), F.col("counts").alias("other_counts"))
        meetings = staying.join(travelling.hint("shuffle_hash"), ["lang", "chunk", "block"]).select("lang", "block", "other_block", "v", "width", "roster", "counts", "other_roster", "other_counts").mapInArrow(_meet, "lang string, a long, b long, value long")
        met = meetings if met is None else met.unionByName(meetings)
    sums = Written(met.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "divergences").df
    drop_all(counts, kept, dealt, entries)
    sides = sums.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("no"), F.col("b").alias("peer")), F.struct(F.col("b").alias("no"), F.col("a").alias("peer")))).alias("s")).select("lang", "value", "s.no", "s.peer")
    name = roster.df.select("lang", "no", "source")
    pairs = sides.join(name, ["lang", "no"]).join(name.select("lang", F.col("no").alias("peer"), F.col("source").alias("item")), ["lang", "peer"]).select("lang", "source", "item", "value")

    ranked = units.df.join(vectors.select("lang", "chunk", "terms", "totals"), ["lang", "chunk"]).select("lang", "v", "lang_n", "roster", "counts", "terms", "totals").mapInArrow(_ranker(top), "lang string, no long, term string, value long")
    terms = ranked.join(name, ["lang", "no"]).select("lang", "source", F.col("term").alias("item"), "value")
    order = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", order.alias("rank"))
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", order.alias("rank")).where(F.col("rank") <= top)
    return pairs.unionByName(terms)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
c AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs
  FROM (SELECT r, lang, source, unnest(terms) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS total FROM c GROUP BY lang, term HAVING sum(docs) >= 10),
l AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(total) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
m AS (
  SELECT g.lang, g.source, k.term, CAST(coalesce(c.n, 0) AS HUGEINT) AS n, l.v, 1 + (1000000000 * (k.total + 2)) // (l.n + 2 * l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, q, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM m),
s AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
      FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 10
"""
