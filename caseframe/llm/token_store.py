"""A content-addressed store of token ids: unique chunks, one recipe for each document, Merkle manifests.

File format, all Parquet in one folder:
  chunks   pack, digest (first 16 bytes of SHA-256 of the content), n_ids, ids (little-endian, 2 bytes each for vocabularies
           of at most 65536 ids, else 4); each content once, packed by digest
  recipes  part, doc_id, start, n_tokens, root, digests (16 bytes for each chunk, in order); ascending doc_id. root is
           the Merkle root of the digests. part is the range of doc_id that the row's file holds
  manifest part, n_docs, n_tokens, root: the Merkle root over the documents' roots in ascending doc_id; and one row for the
           whole store, part -1, whose root is over the parts' roots

A document's ids are cut where a rolling hash of the last WINDOW ids has its low bits zero, so that equal passages give
equal chunks wherever they stand. Each task sends a content once to the pack that its digest names; the pack's task keeps
one. Reading back hashes every chunk anew; a document's crc is put together from its chunks' crcs, its root from their
digests, so that verifying moves no ids, and counts as intact only where its part agrees with the manifest. verify_parts() names
parts that are lost or changed. read_documents() gives the ids themselves.

Null and empty texts have the end id alone. Documents with equal ids share all chunks. Rows that repeat a doc_id are
stored as documents of their own, in any order among themselves; rows without doc_id are left out. An empty table gives empty files; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseframe.llm.common import Written, joined, shuffle_width, slices, whole_texts
from caseframe.llm.tokens import Encoder, tokenizer_path

END_ID = 1
WINDOW, LEAST, MOST, MEAN_BITS = 8, 64, 2048, 8
#: A random 32-bit code for each of 65,536 classes of ids.
_CODES = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 32, 1 << 16, dtype=np.uint32)
DIGEST = 16
#: Documents of a part, about.
PART_DOCS = 1_000_000


def digest(content: bytes) -> bytes:
    return hashlib.sha256(content).digest()[:DIGEST]


def merkle_root(leaves: list[bytes]) -> bytes:
    """Pairs are hashed together level by level; an odd one moves up as it is."""
    while len(leaves) > 1:
        pairs = [hashlib.sha256(a + b).digest()[:DIGEST] for a, b in zip(leaves[::2], leaves[1::2], strict=False)]
        leaves = pairs + leaves[len(pairs) * 2 :]
    return leaves[0] if leaves else digest(b"")


def cut_points(ids: np.ndarray, texts: np.ndarray) -> list[list[int]]:
    """For each text (texts: where each one begins in ids, and the end) the ends of its chunks."""
    codes = _CODES[ids & np.uint32(0xFFFF)]
    rolling = codes.copy()
    for back in range(1, WINDOW):
        rolling[back:] += codes[:-back] << np.uint32(back)
    hits = np.flatnonzero((rolling * np.uint32(0x9E3779B1)) >> np.uint32(32 - MEAN_BITS) == 0) + 1
    out = []
    for begin, end, lo, hi in zip(texts[:-1].tolist(), texts[1:].tolist(), np.searchsorted(hits, texts[:-1] + WINDOW).tolist(), np.searchsorted(hits, texts[1:]).tolist(), strict=True):
        ends, last = [], begin
        for hit in hits[lo:hi].tolist():
            while hit - last > MOST:
                last += MOST
                ends.append(last)
            if hit - last >= LEAST:
                ends.append(hit)
                last = hit
        while end - last > MOST:
            last += MOST
            ends.append(last)
        if end > last or not ends:
            ends.append(end)
        out.append(ends)
    return out


def _staged(docs: DataFrame, path: str, end_id: int, by_chunk: bool, width: int) -> DataFrame:
    end, kind = np.array([end_id], "<u4").tobytes(), f"<u{width}"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sent = Encoder.of(path, by_chunk), set()
        for doc_ids, texts in slices(batches):
            tokens = [t + end for t in encoder.encode(texts)]
            bounds = np.concatenate([[0], np.cumsum([len(t) // 4 for t in tokens])])
            ids = np.frombuffer(b"".join(tokens), "<u4")
            content = ids.astype(kind).tobytes()
            digests, news, names, contents = [], [0], [], []
            for begin, ends in zip(bounds[:-1].tolist(), cut_points(ids, bounds), strict=True):
                mine = []
                for stop in ends:
                    chunk = content[width * begin : width * stop]
                    d = digest(chunk)
                    mine.append(d)
                    if d not in sent:
                        sent.add(d)
                        names.append(d)
                        contents.append(chunk)
                    begin = stop
                digests.append(b"".join(mine))
                news.append(len(names))
            rows = pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(contents, pa.binary())], ["digest", "ids"])
            offsets = pa.array(news, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(offsets, rows)], ["doc_id", "n_tokens", "digests", "new"])
            if len(sent) > 1_000_000:
                sent.clear()  # the pack drops what is sent twice

    return whole_texts(docs).mapInArrow(cut, "doc_id long, n_tokens long, digests binary, new array<struct<digest:binary,ids:binary>>")


def _unique(width: int):
    """The first of each run of equal digests, from sorted rows."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            mask = []
            for d in batch.column("digest").to_pylist():
                mask.append(d != last)
                last = d
            kept = batch.filter(pa.array(mask, pa.bool_()))
            lengths = pa.compute.binary_length(kept.column("ids")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([kept.column("pack"), kept.column("digest"), pa.compute.divide(lengths, width), kept.column("ids")], ["pack", "digest", "n_ids", "ids"])

    return keep


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roots = [merkle_root([d[i : i + DIGEST] for i in range(0, len(d), DIGEST)]) for d in batch.column("digests").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.binary())], [*batch.schema.names, "root"])


def write_store(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, by_chunk: bool = True) -> None:
    """Writes the three tables of the format."""
    spark, path = docs.sparkSession, path or tokenizer_path()
    width = 2 if Encoder.of(path, by_chunk).vocabulary <= 1 << 16 and end_id < 1 << 16 else 4
    staged = Written(_staged(docs, path, end_id, by_chunk, width), "staged", compression="zstd")

    packs = max(shuffle_width(spark), -(-staged.df.count() // PART_DOCS))
    new = staged.df.select(F.explode("new").alias("x")).select("x.digest", "x.ids")
    new = new.withColumn("pack", F.pmod(F.xxhash64("digest"), F.lit(packs)).cast("int")).repartition(packs, "pack").sortWithinPartitions("pack", "digest")
    new.mapInArrow(_unique(width), "pack int, digest binary, n_ids long, ids binary").write.option("compression", "zstd").parquet(f"{folder}/chunks")

    recipes = staged.df.select("doc_id", "n_tokens", "digests").repartitionByRange(packs, "doc_id").sortWithinPartitions("doc_id")
    sorted_ = Written(recipes.withColumn("part", F.spark_partition_id()).mapInArrow(_roots, "doc_id long, n_tokens long, digests binary, part int, root binary"), "recipes")
    parts = sorted_.df.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row for each range of doc_id: as many as shuffle partitions
    before = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = W.partitionBy("part").orderBy("doc_id", "n_tokens", "digests").rowsBetween(W.unboundedPreceding, -1)
    placed = sorted_.df.join(F.broadcast(before), "part").withColumn("start", (F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).cast("long"))
    placed.select("part", "doc_id", "start", "n_tokens", "root", "digests").write.parquet(f"{folder}/recipes")

    parts = Written(_part_roots(spark.read.parquet(f"{folder}/recipes")), "manifest")
    parts.df.unionByName(_store_root(parts.df)).write.parquet(f"{folder}/manifest")
    for t in (staged, sorted_, parts):
        t.drop()


_MANIFEST = "part int, n_docs long, n_tokens long, root binary"


def _part_roots(recipes: DataFrame) -> DataFrame:
    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("start", kind="stable")
        return pd.DataFrame({"part": [key[0]], "n_docs": [len(rows)], "n_tokens": [rows["n_tokens"].sum()], "root": [merkle_root(list(rows["root"]))]})

    return recipes.select("part", "start", "n_tokens", "root").groupBy("part").applyInPandas(one, _MANIFEST)


def _store_root(parts: DataFrame) -> DataFrame:
    """The row of the whole store, from one row for each part."""

    def all_(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        return pd.DataFrame({"part": [-1], "n_docs": [rows["n_docs"].sum()], "n_tokens": [rows["n_tokens"].sum()], "root": [merkle_root(list(rows["root"]))]})

    return parts.groupBy(F.lit(0).alias("all")).applyInPandas(all_, _MANIFEST)


def verify_parts(spark: SparkSession, folder: str) -> DataFrame:
    """part, n_docs (found), intact of every part that the manifest or the recipes name, and of the store (part -1): the numbers and
    the Merkle roots of the recipes are those of the manifest."""
    told = spark.read.parquet(f"{folder}/manifest").select("part", *(F.col(c).alias(f"told_{c}") for c in ("n_docs", "n_tokens", "root")))
    found = _part_roots(spark.read.parquet(f"{folder}/recipes"))
    same = F.col("n_docs").eqNullSafe(F.col("told_n_docs")) & F.col("n_tokens").eqNullSafe(F.col("told_n_tokens")) & F.col("root").eqNullSafe(F.col("told_root"))
    both = found.unionByName(_store_root(found)).join(told, "part", "full")
    return both.select("part", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), same.alias("intact"))


def _times(matrix: list[int], vector: int) -> int:
    total = 0
    for row in matrix:
        if vector & 1:
            total ^= row
        vector >>= 1
    return total


def _zero_byte_tables(most_bits: int = 40) -> list[np.ndarray]:
    """For each k, what appending 2**k zero bytes makes of a crc, as four tables of 256: it is linear in the 32 bits."""
    matrix = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit (the polynomial of crc32)
    for _ in range(3):
        matrix = [_times(matrix, row) for row in matrix]
    out = []
    for _ in range(most_bits):
        out.append(np.array([[_times(matrix[8 * b : 8 * b + 8], v) for v in range(256)] for b in range(4)], np.uint32))
        matrix = [_times(matrix, row) for row in matrix]
    return out


def joined_crcs(crcs: np.ndarray, sizes: np.ndarray, first: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """crc32 of each group's concatenation; groups begin at `first` and none is empty. A part counts as its crc carried
    over the bytes after it, and the group's crc is the exclusive or of its parts'."""
    ends = np.cumsum(sizes)
    group_end = ends[np.append(first[1:], len(sizes)) - 1]
    after = np.repeat(group_end, np.diff(np.append(first, len(sizes)))) - ends
    out, k = crcs.astype(np.uint32), 0
    while (after >> k).any():
        odd = (after >> k & 1).astype(bool)
        x, t = out[odd], tables[k]
        out[odd] = t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24]
        k += 1
    return np.bitwise_xor.reduceat(out, first) if len(first) else out


def _checked(width: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs, sizes, ok = [], [], []
            for d, content in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                crcs.append(zlib.crc32(content if width == 4 else np.frombuffer(content, "<u2").astype("<u4").tobytes()))
                sizes.append(len(content) // width)
                ok.append(digest(content) == d)
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(crcs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ok, pa.bool_())], ["digest", "crc", "n_ids", "intact"])

    return check


def _width(spark: SparkSession, folder: str) -> int:
    row = spark.read.parquet(f"{folder}/chunks").select((F.length("ids") / F.col("n_ids")).cast("int").alias("w")).first()
    return row["w"] if row else 2


def _recipe_chunks(recipes: DataFrame) -> DataFrame:
    """One row for each chunk of each document, in order by seq."""
    n = (F.length("digests") / DIGEST).cast("int")
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("seq"), F.substring(F.col("digests"), (i - 1) * DIGEST + 1, F.lit(DIGEST)).alias("digest")))
    return recipes.select("doc_id", "start", "n_tokens", "root", F.explode(each).alias("x")).select("doc_id", "start", "n_tokens", "root", "x.seq", "x.digest")


def verify_store(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_chunks and intact (every chunk hashes to its digest, the digests to the root,
    and the lengths add up) for each document, from the files."""
    chunks = spark.read.parquet(f"{folder}/chunks").select("digest", "ids").mapInArrow(_checked(_width(spark, folder)), "digest binary, crc long, n_ids long, intact boolean")
    sound = F.broadcast(verify_parts(spark, folder).select("part", F.col("intact").alias("sound")))  # one row for each part
    recipes = spark.read.parquet(f"{folder}/recipes").join(sound, "part", "left").withColumn("n_tokens", F.when(F.col("sound"), F.col("n_tokens")).otherwise(F.lit(-1)))
    found = _recipe_chunks(recipes).join(chunks, "digest", "left")
    documents = found.groupBy("start", "doc_id", "n_tokens", "root").agg(F.array_sort(F.collect_list(F.struct("seq", "digest", "crc", "n_ids", "intact"))).alias("parts"))

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _zero_byte_tables()
        for batch in batches:
            column = batch.column("parts")
            parts, first = column.flatten(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
            digests = parts.field("digest").to_pylist()
            crc, size = (parts.field(c).fill_null(0).to_numpy() for c in ("crc", "n_ids"))
            fine = parts.field("intact").fill_null(False).to_numpy(zero_copy_only=False)
            whole = np.logical_and.reduceat(fine, first[:-1]) if batch.num_rows else fine
            n = np.add.reduceat(size, first[:-1]) if batch.num_rows else size
            roots = [merkle_root(digests[a:b]) == r for a, b, r in zip(first[:-1].tolist(), first[1:].tolist(), batch.column("root").to_pylist(), strict=True)]
            intact = whole & np.array(roots, bool) & (n == batch.column("n_tokens").to_numpy())
            crcs = joined_crcs(crc, 4 * size, first[:-1], tables).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(n, pa.int64()), pa.array(crcs, pa.int64()), pa.array(np.diff(first), pa.int64()), pa.array(intact, pa.bool_())], ["doc_id", "start", "n_tokens", "ids_crc32", "n_chunks", "intact"])

    return documents.mapInArrow(put_together, "doc_id long, start long, n_tokens long, ids_crc32 long, n_chunks long, intact boolean")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start and ids (as stored) of every document, rebuilt from recipes and chunks."""
    chunks = spark.read.parquet(f"{folder}/chunks").select("digest", "ids")
    found = _recipe_chunks(spark.read.parquet(f"{folder}/recipes")).join(chunks, "digest")
    parts = F.array_sort(F.collect_list(F.struct("seq", "ids")))
    return found.groupBy("start", "doc_id").agg(joined(parts).alias("ids"))
