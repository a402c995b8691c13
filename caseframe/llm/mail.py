"""Messages between buckets of documents and groups of fingerprints.

Documents are dealt into buckets by doc_id, so that the rows of one doc_id are always together. A bucket's task sends each group
one row of packed arrays; a group's task answers each bucket with one row. Later looks at the documents use the same
exchange of texts again. No row is made for each fingerprint, and a task holds one bucket's texts or one group's arrays.

The sizes of buckets and groups follow the bytes of text: UNIT words each, and more where the number of messages (buckets
times groups) would otherwise grow faster than the input: messages hold 64 words at least on the mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseframe.llm.common import group_slices, tidy

#: Words that a bucket or a group is made for, and bytes of text for each.
UNIT, WORD_BYTES = 2_500_000, 6
MAIL = "bucket int, part int, grp int, payload binary"
MAIL_SCHEMA = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("grp", pa.int32()), ("payload", pa.binary())])


@dataclass
class Bucketed:
    """bucket and texts, dealt by bucket: packed, or row by row with `rest` (a struct of the other columns) where asked for."""

    texts: DataFrame
    buckets: int
    words: int  # by the bytes of text
    unit: int


_PACKED = "bucket int, ids binary, sizes binary, body binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of a batch that go to one bucket as one compressed row."""
    for batch in batches:
        bucket, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "doc_id"))
        texts = _binary(batch.column("text"))
        order = np.argsort(bucket, kind="stable")
        rows = []
        for b, part in group_slices(bucket[order]):
            own = [texts[i] for i in order[part].tolist()]
            sizes = np.array([len(t) for t in own], "<u4")
            rows.append((b, ids[order[part]].astype("<i8").tobytes(), sizes.tobytes(), squeeze(b"".join(own))))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "ids", "sizes", "body"])


def bucketed(docs: DataFrame, carry: bool = False, unit: int = UNIT) -> Bucketed:
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    words = size // WORD_BYTES + 1
    unit = max(unit, int((64 * words) ** 0.5))
    buckets = -(-words // unit)
    own = [F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(buckets)).cast("int").alias("bucket"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")]
    if carry:
        own.append(F.struct(F.col("text").isNull().alias("__no_text"), *(F.col(f"`{c}`").alias(c) for c in docs.columns if c not in ("doc_id", "text"))).alias("rest"))
    rows = docs.where(F.col("doc_id").isNotNull()).select(*own)
    return Bucketed((rows if carry else rows.mapInArrow(tidy(_pack), _PACKED)).repartition(buckets, "bucket"), buckets, words, unit)


def _binary(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def ordered(table: pa.Table) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(doc_ids, texts as UTF-8, rows of the table), by doc_id and text, so that every look at a bucket sees one order."""
    if "text" in table.column_names:
        ids, texts = table.column("doc_id").to_numpy(), _binary(table.column("text"))
    else:
        found, texts = [np.empty(0, np.int64)], []
        for numbers, sizes, body in zip(*(table.column(c).to_pylist() for c in ("ids", "sizes", "body")), strict=True):
            found.append(np.frombuffer(numbers, "<i8"))
            whole, ends = stretch(body), np.cumsum(np.frombuffer(sizes, "<u4"), dtype=np.int64)
            texts += [whole[a:z] for a, z in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        ids = np.concatenate(found)
    order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
    return ids[order], [texts[i] for i in order], np.array(order, np.int64)


def mail_table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, MAIL_SCHEMA, strict=True)], schema=MAIL_SCHEMA)


def letters(table: pa.Table) -> dict[tuple[int, int], bytes]:
    """The payloads of a bucket's answers by (part, group)."""
    return dict(zip(zip(table.column("part").to_pylist(), table.column("grp").to_pylist(), strict=True), table.column("payload").to_pylist(), strict=True))


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def stretch(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def planes(values: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, which compress better so."""
    return squeeze(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def unplanes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(stretch(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit values as differences."""
    return planes(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unplanes(packed, "<u8"), dtype=np.uint64)
