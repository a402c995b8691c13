"""Line deduplication with a sharded minimal perfect hash over distinct line hashes.

A line's key is the line stripped of ASCII white space and lower-cased (A-Z). Keys of at least LEAST_LENGTH code points are hashed.

Counting: one row for each (hash, doc_id), then one for each hash with its number of documents and largest doc_id; both
aggregations combine before the shuffle, so that a line in a third of all documents is a row for each task.
Index: distinct hashes are dealt into shards of SHARD keys. A shard numbers its keys by a minimal perfect hash (levels of bit
arrays; a key that is alone in its cell gets the cell's rank, others go on to the next level) and keeps arrays of
fingerprints, counts and largest doc_ids in that order; its bytes are one row of a table in the shared folder. The keys themselves
aren't kept.
Probing: each bucket of documents sends its distinct hashes to the shards that they belong to, packed, one row for each shard.
A shard's task looks them up in the arrays and answers which are repeated, and the largest doc_id. Lines are never joined.

Null and empty texts are one empty line. Short keys stay. A document that holds a key several times counts once and, if
it is the last to hold it, keeps all its lines. Rows that repeat a doc_id are one document for counting, and each row loses its own
lines. Rows without doc_id give no result; without_repeated_lines() returns them as they are. Other columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseframe.llm import mail
from caseframe.llm.common import Written, group_slices, mix, slices, tidy, whole_texts

LEAST_LENGTH, LEAST_DOCS = 20, 3
WHITE = b" \t\n\x0b\x0c\r"
#: Keys of a shard of the index.
SHARD = 1_000_000
_INDEX = "grp int, payload binary"
_HASH = np.dtype([("hash", "<u8"), ("print", "<u4")])


def line_key(line: bytes) -> bytes:
    return line.strip(WHITE).lower()


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode("utf-8")) >= least)


def line_hash(key: bytes) -> bytes:
    """12 bytes: the 64-bit hash that is indexed, and a 32-bit fingerprint of its own."""
    return hashlib.blake2b(key, digest_size=12).digest()


def text_hashes(text: bytes, least_length: int) -> tuple[list[int], list[bytes]]:
    """(numbers of the lines whose keys are long enough, their hashes)."""
    keys = [(i, k) for i, k in enumerate(map(line_key, text.split(b"\n"))) if long_enough(k, least_length)]
    return [i for i, _ in keys], [line_hash(k) for _, k in keys]


class PerfectHash:
    """Numbers n distinct 64-bit keys 0 to n - 1; keys outside get -1 or any number."""

    def __init__(self, keys: np.ndarray, spread: float = 1.6):
        self.levels: list[np.ndarray] = []
        while len(keys):
            size = max(8, int(len(keys) * spread))
            cell = self._cell(keys, len(self.levels), size)
            alone = np.bincount(cell, minlength=size) == 1
            keys = keys[~alone[cell]]
            self.levels.append(alone)
        self._rank()

    def _rank(self) -> None:
        self.ranks, base = [], 0
        for alone in self.levels:
            self.ranks.append(np.cumsum(alone) - 1 + base)
            base += int(alone.sum())
        self.size = base

    @staticmethod
    def _cell(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys ^ np.uint64((level + 1) * 0xA24BAED4963EE407 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (alone, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            cell = self._cell(keys[open_], level, len(alone))
            here = alone[cell]
            out[open_[here]] = rank[cell[here]]
            open_ = open_[~here]
        return out

    def dump(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<u4")
        return sizes.tobytes() + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def load(cls, data: bytes) -> tuple[PerfectHash, int]:
        """(the perfect hash, the bytes that it takes)."""
        out, n = cls.__new__(cls), int(np.frombuffer(data, "<u4", 1)[0])
        out.levels, at = [], 4 + 4 * n
        for size in np.frombuffer(data, "<u4", n, 4).tolist():
            taken = -(-size // 8)
            out.levels.append(np.unpackbits(np.frombuffer(data, np.uint8, taken, at), count=size).astype(bool))
            at += taken
        out._rank()
        return out, at


class LineIndex:
    """One shard: a perfect hash of the 64-bit hashes, and fingerprints, counts and last documents by its numbers. Keys that share
    a hash but not a fingerprint (one in 10 ** 19 pairs) lie behind the arrays, by hash."""

    def __init__(self, hashes: np.ndarray, prints: np.ndarray, counts: np.ndarray, last: np.ndarray):
        order = np.lexsort((prints, hashes))
        hashes, prints, counts, last = hashes[order], prints[order], counts[order], last[order]
        first = np.concatenate([[True], hashes[1:] != hashes[:-1]]) if len(hashes) else np.empty(0, bool)
        self.number = PerfectHash(hashes[first])
        at = self.number(hashes[first])
        self.prints, self.counts, self.last = (np.empty(len(at), kind) for kind in ("<u4", "<i8", "<i8"))
        self.prints[at], self.counts[at], self.last[at] = prints[first], counts[first], last[first]
        self.more = tuple(x[~first].astype(k) for x, k in ((hashes, "<u8"), (prints, "<u4"), (counts, "<i8"), (last, "<i8")))

    def probe(self, hashes: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents that hold the key, the last of them); 0 and -1 for keys that are not here."""
        at = self.number(hashes)
        there = (at >= 0) & (len(self.prints) > 0)
        there[there] = self.prints[at[there]] == prints[there]
        count, last = np.zeros(len(hashes), np.int64), np.full(len(hashes), -1, np.int64)
        count[there], last[there] = self.counts[at[there]], self.last[at[there]]
        for h, p, n, d in zip(*(x.tolist() for x in self.more), strict=True):
            same = (hashes == np.uint64(h)) & (prints == np.uint32(p))
            count[same], last[same] = n, d
        return count, last

    def dump(self) -> bytes:
        parts = [self.number.dump(), self.prints.tobytes(), self.counts.tobytes(), self.last.tobytes(), *(x.tobytes() for x in self.more)]
        return np.array([len(self.prints), len(self.more[0])], "<u4").tobytes() + b"".join(parts)

    @classmethod
    def load(cls, data: bytes) -> LineIndex:
        out, (n, more) = cls.__new__(cls), np.frombuffer(data, "<u4", 2).tolist()
        out.number, at = PerfectHash.load(data[8:])
        at += 8
        arrays = []
        for kind, size in (("<u4", n), ("<i8", n), ("<i8", n), ("<u8", more), ("<u4", more), ("<i8", more), ("<i8", more)):
            arrays.append(np.frombuffer(data, kind, size, at))
            at += size * np.dtype(kind).itemsize
        out.prints, out.counts, out.last, out.more = arrays[0], arrays[1], arrays[2], tuple(arrays[3:])
        return out


def line_counts(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """hash, print, n (documents that hold the line) and last (the largest doc_id) for each distinct line."""

    @tidy
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            docs_, hashes = [], []
            for doc_id, text in zip(ids.tolist(), texts, strict=True):
                own = set(text_hashes(text, least_length)[1])
                docs_ += [doc_id] * len(own)
                hashes += own
            found = np.frombuffer(b"".join(hashes), _HASH)
            yield pa.RecordBatch.from_arrays([pa.array(found["hash"].astype(np.int64)), pa.array(found["print"].astype(np.int64)), pa.array(docs_, pa.int64())], ["hash", "print", "doc_id"])

    held = whole_texts(docs).mapInArrow(look, "hash long, print long, doc_id long").distinct()
    return held.groupBy("hash", "print").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """In the order of the hashes, by their highest 32 bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def build_index(counts: DataFrame, shards: int) -> DataFrame:
    """grp (shard) and payload (its perfect hash and arrays)."""

    def build(table: pa.Table) -> pa.Table:
        hashes, prints, n, last = (table.column(c).to_numpy() for c in ("hash", "print", "n", "last"))
        index = LineIndex(hashes.view(np.uint64), prints.astype(np.uint32), n, last)
        return pa.table([pa.array([table.column("grp")[0].as_py()], pa.int32()), pa.array([index.dump()], pa.binary())], ["grp", "payload"])

    grp = F.shiftrightunsigned(F.shiftrightunsigned("hash", 32) * F.lit(shards), 32).cast("int")
    return counts.withColumn("grp", grp).groupBy("grp").applyInArrow(build, _INDEX)


def without_repeated_lines(docs: DataFrame, least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The documents with all their columns and what is left of their texts. A column n_chars, the number of code points of a
    document's text in `documents`, is counted anew where a text has lost lines; null texts stay null."""
    left = drop_repeated_lines(docs, least_length, least_docs, carry=True)
    changed = F.col("n_dropped") > 0
    rest = lambda c: F.col("rest").getField(c)
    own = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.when(~rest("__no_text"), F.col("kept"))}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(changed, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(rest("n_chars"))
    named = left.select(*((own[c] if c in own else rest(c)).alias(c) for c in docs.columns))
    return named.unionByName(docs.where(F.col("doc_id").isNull()))


def drop_repeated_lines(docs: DataFrame, least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS, carry: bool = False, shard: int = SHARD, unit: int = mail.UNIT) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept (the lines left, joined by a line end)."""
    counts = Written(line_counts(docs, least_length), "line-counts")
    shards = -(-max(1, counts.df.count()) // shard)
    index = Written(build_index(counts.df, shards), "line-index").df
    counts.drop()
    own = mail.bucketed(docs, carry, unit)

    def distinct(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(distinct hashes of a bucket by shard and hash, their shards)."""
        found = np.unique(np.frombuffer(b"".join(h for t in texts for h in set(text_hashes(t, least_length)[1])), _HASH))
        return found, shard_of(found["hash"], shards)

    def ask(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        found, shard_ = distinct(mail.ordered(table)[1])
        return mail.mail_table([(bucket, 0, s, found[at].tobytes()) for s, at in group_slices(shard_)])

    def look_up(asked: pa.Table, index: pa.Table) -> pa.Table:
        rows = []
        if len(asked):
            arrays = LineIndex.load(index.column("payload")[0].as_py())
            for bucket, s, payload in zip(*(asked.column(c).to_pylist() for c in ("bucket", "grp", "payload")), strict=True):
                found = np.frombuffer(payload, _HASH)
                count, last = arrays.probe(found["hash"].copy(), found["print"].copy())
                many = np.flatnonzero(count >= least_docs)
                if len(many):
                    rows.append((bucket, 0, s, np.array(len(many), "<u4").tobytes() + many.astype("<u4").tobytes() + last[many].astype("<i8").tobytes()))
        return mail.mail_table(rows)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts, order = mail.ordered(left)
        told = mail.letters(right)
        found, shard_ = distinct(texts) if told else (None, None)
        last: dict[bytes, int] = {}
        for s, at in group_slices(shard_) if told else ():
            if (0, s) in told:
                payload = told[0, s]
                n = int(np.frombuffer(payload, "<u4", 1)[0])
                names = found[at][np.frombuffer(payload, "<u4", n, 4)]
                last |= {h.tobytes(): d for h, d in zip(names, np.frombuffer(payload, "<i8", n, 4 + 4 * n).tolist(), strict=True)}
        n_lines, n_dropped, kept = [], [], []
        for doc_id, text in zip(ids.tolist(), texts, strict=True):
            numbers, hashes = text_hashes(text, least_length) if last else ([], [])
            drop = {i for i, h in zip(numbers, hashes, strict=True) if last.get(h, doc_id) != doc_id}
            n_lines.append(text.count(b"\n") + 1)
            n_dropped.append(len(drop))
            kept.append(b"\n".join(x for i, x in enumerate(text.split(b"\n")) if i not in drop) if drop else text)
        columns = [pa.array(ids, pa.int64()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        names = ["doc_id", "n_lines", "n_dropped", "kept"]
        if carry:
            columns.append(left.column("rest").take(pa.array(order)).combine_chunks())
            names.append("rest")
        return pa.table(columns, names)

    schema = docs.sparkSession.createDataFrame([], "doc_id long, n_lines long, n_dropped long, kept string").schema
    if carry:
        schema = schema.add("rest", own.texts.schema["rest"].dataType)
    asked = own.texts.groupBy("bucket").applyInArrow(ask, mail.MAIL)
    answered = asked.groupBy("grp").cogroup(index.groupBy("grp")).applyInArrow(look_up, mail.MAIL)
    return own.texts.groupBy("bucket").cogroup(answered.groupBy("bucket")).applyInArrow(finish, schema)


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
k AS (SELECT doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.i, k.line, g.key IS NOT NULL AND k.doc_id <> g.last AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
