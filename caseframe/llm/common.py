"""What several operators share: shared-folder tables, text slices for numpy, word fingerprints and packed messages.

The numpy helpers work on slices of a few MB of text inside a task; Spark partitions, shuffles and groups the work.
"""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import suppress
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Bytes of text that numpy handles at once; temporary arrays take about 60 bytes for each.
SLICE_BYTES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text only, null texts as empty; columns beyond these are not looked at, whatever their names.

    Rows without a doc_id can't be named in a result and are left out."""
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def one_text_each(docs: DataFrame) -> DataFrame:
    """whole_texts() with one row for each doc_id: of rows that repeat one, the smallest text."""
    texts = whole_texts(docs)
    twice = Written(texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "repeated-ids").df
    smallest = Written(texts.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")), "repeated-texts").df
    return texts.join(twice, "doc_id", "left_anti").unionByName(smallest)


def shuffle_width(spark: SparkSession) -> int:
    """The cluster's own setting of the number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may go without the setting (it gets a folder of its own)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="caseframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Written:
    """A table in the shared folder that cuts lineage; drop() frees it when nothing reads it any more.

    What a returned DataFrame still reads can't be dropped here; it lies under <shared folder>/caseframe/."""

    def __init__(self, df: DataFrame, what: str, **options: str):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/caseframe/{what}-{uuid.uuid4().hex}"
        df.write.options(**options).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def drop_all(*tables: Written | None) -> None:
    for t in tables:
        if t is not None:
            t.drop()


def clear(spark: SparkSession) -> None:
    """Deletes all that operators have left in the shared folder: what results that are still to be read need, too."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/caseframe")
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Rows of a bucket that numbered() ranks in one task.
BUCKET_ROWS = 500_000


def numbered(df: DataFrame, within: list[str], key: str, name: str, rows: int, buckets: int | None = None, few_groups: bool = True) -> DataFrame:
    """A gapless long from 0 in each group of `within`, without gathering a group in one task.

    Rows are bucketed by a hash of `key` (unique, or ties are ordered anyhow); a row's number is the size of the
    earlier buckets of its group, from a table of at most groups x buckets rows, plus its rank in its own bucket. `rows` bounds
    the rows of the largest group; the number of buckets follows it. The table is broadcast where the caller knows that the
    groups are few (shards, lengths)."""
    b = f"__{name}_bucket"
    buckets = buckets or max(8, -(-rows // BUCKET_ROWS))
    df = df.withColumn(b, F.pmod(F.xxhash64(F.col(key), F.lit(name)), F.lit(buckets)).cast("int"))
    sizes = df.groupBy(*within, b).agg(F.count(F.lit(1)).alias("__n"))
    over = W.partitionBy(*within).orderBy(b).rowsBetween(W.unboundedPreceding, -1) if within else W.orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(over), F.lit(0))).drop("__n")
    rank = F.row_number().over(W.partitionBy(*within, b).orderBy(key))
    joined = df.withColumn("__rank", rank).join(F.broadcast(offsets) if few_groups else offsets, [*within, b])
    return joined.withColumn(name, (F.col("__before") + F.col("__rank") - 1).cast("long")).drop(b, "__before", "__rank")


def joined(parts: Column) -> Column:
    """The `ids` of an array of structs as one binary."""
    return F.unhex(F.array_join(F.transform(parts, lambda x: F.hex(x["ids"])), ""))


def release() -> None:
    """Gives memory that a Python worker has freed back to the system: workers stay for later stages."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # another C library has no such function
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(f):
    """A function over batches that releases memory when its task ends."""

    @wraps(f)
    def run(batches):
        yield from f(batches)
        release()

    return run


# ---------------------------------------------------------------------------------------------------------------
# slices of text


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(doc_ids, texts as UTF-8) from batches with doc_id and text columns, `most` bytes at a time or one document."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):  # Python objects of a part of the batch at a time
            batch = whole.slice(at, 1024)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            column = batch.column("text")
            texts = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()
            begin, size = 0, 0
            for i, text in enumerate(texts):
                if i > begin and size + len(text) > most:
                    yield ids[begin:i], texts[begin:i]
                    begin, size = i, 0
                size += len(text)
            if begin < len(texts):
                yield ids[begin:], texts[begin:]


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Separators of alphanumeric words: ASCII but 0-9 and a-z (texts are lower-cased before); all other bytes are word bytes.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = True
NOT_ALNUM[ord("0") : ord("9") + 1] = False
NOT_ALNUM[ord("a") : ord("z") + 1] = False

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Longer words are digested by blake2b.
_LOADED = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def chain(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """One fingerprint of two in order. No sum or polynomial: a bijection of either one for each value of the other, so that
    regular texts cancel nothing out."""
    with np.errstate(over="ignore"):
        return mix(mix(a * _MULTIPLIER + _SEEDS[seed]) ^ b)


def span_digests(buffer: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit fingerprint of buffer[start:end] for each pair: eight bytes at a time, one to one for spans of up to eight."""
    size = ends - starts
    padded = np.frombuffer(buffer + bytes(8), np.uint8)
    eight = np.ndarray((len(buffer) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from every place on
    tail = np.minimum(size, 8).astype(np.uint64)
    mask = np.where(tail == 8, np.uint64((1 << 64) - 1), (np.uint64(1) << (np.uint64(8) * (tail % np.uint64(8)))) - np.uint64(1))
    with np.errstate(over="ignore"):
        out = mix((eight[starts] & mask) ^ mix(size.astype(np.uint64) * _SEEDS[seed]))
    long = np.flatnonzero((size > 8) & (size <= _LOADED))
    step = 8
    while len(long):
        tail = np.minimum(size[long] - step, 8).astype(np.uint64)
        mask = np.where(tail == 8, np.uint64((1 << 64) - 1), (np.uint64(1) << (np.uint64(8) * (tail % np.uint64(8)))) - np.uint64(1))
        out[long] = chain(out[long], eight[starts[long] + step] & mask, seed)
        step += 8
        long = long[size[long] > step]
    for i in np.flatnonzero(size > _LOADED).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buffer[starts[i] : ends[i]], digest_size=8, salt=bytes([seed])).digest(), "little")
    return out


def window_digests(values: np.ndarray, n: int, seed: int = 1, levels: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """A 64-bit fingerprint of every n consecutive values, put together from those of 1, 2, 4, ... values, which `levels` gets."""
    count = len(values) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    power, width, out, done = values, 1, None, 0
    while True:
        if levels is not None:
            levels[width] = power
        if n & width:
            part = power[done : done + count]
            out = part if out is None else chain(out, part, seed)
            done += width
        if done == n:
            return out
        power = chain(power[:-width], power[width:], seed)
        width *= 2


def sequence_digests(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 2) -> np.ndarray:
    """A 64-bit fingerprint of values[start:end] for each pair of disjoint ascending spans: a balanced tree over each span."""
    size = ends - starts
    at = np.arange(int(size.sum())) + np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(size) else np.empty(0, np.int64)
    level, of = values[at], np.repeat(np.arange(len(size)), size)
    while True:
        begins = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.empty(0, np.int64)
        if len(begins) == len(of):
            break
        odd = (np.arange(len(of)) - np.repeat(begins, np.diff(np.append(begins, len(of))))) % 2 == 1
        right = np.flatnonzero(odd)  # one without a partner goes up as it is
        level[right - 1] = chain(level[right - 1], level[right], seed)
        level, of = level[~odd], of[~odd]
    out = np.zeros(len(size), np.uint64)
    out[of] = level
    return chain(out, size.astype(np.uint64), seed)


class Words:
    """The words of some texts: byte spans in the joined buffer, fingerprints, and each one's text number."""

    def __init__(self, texts: list[bytes], separators: np.ndarray = SPACE):
        self.buffer = b"\n".join(texts) + b"\n"
        data = np.frombuffer(self.buffer, np.uint8)
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = ~separators[data]
        edges = np.flatnonzero(np.diff(inside))
        self.starts, self.ends = edges[::2], edges[1::2]
        self.hashes = span_digests(self.buffer, self.starts, self.ends)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_starts = np.concatenate([[0], np.cumsum(lengths)])
        #: words of text i: first[i] to first[i + 1]
        self.first = np.searchsorted(self.starts, self.text_starts)
        self.text_of = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first words, fingerprints) of all windows of n consecutive words of one text."""
        first = np.arange(max(0, len(self.hashes) - n + 1))
        first = first[self.text_of[first] == self.text_of[first + n - 1]] if len(first) else first
        return first, window_digests(self.hashes, n)[first]


def group_slices(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(key, slice) of each run of equal sorted keys."""
    if len(keys):
        cuts = np.flatnonzero(np.diff(keys)) + 1
        bounds = np.concatenate([[0], cuts, [len(keys)]])
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield int(keys[a]), slice(int(a), int(b))
