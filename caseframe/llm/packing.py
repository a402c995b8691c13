"""Packing of token ids into sequences of bounded length by minimum bin slack.

A document's ids (its text's, then an end id) are cut at multiples of the capacity. Full pieces are sequences of their
own. The rest, one shorter piece for each document, are packed on their histogram of lengths (at most capacity - 1 rows,
whatever the input): the longest remaining length opens a window, a bitset subset-sum over the remaining lengths finds
the total closest to what is left, backtracking gives the lengths with their counts, and that multiset is repeated as
often as the counts allow. Spark ranks the pieces of each length and looks each rank up in the plan.

Nulls count as empty texts and an empty text is its end id alone; equal lengths are told apart by doc_id and start;
repeated rows are packed each for itself; rows without doc_id are left out; an empty table gives no rows; columns but doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseframe.llm.common import Written, joined, numbered, release, slices, tidy, whole_texts
from caseframe.llm.tokens import Encoder, tokenizer_path

CAPACITY = 4096
END_ID = 2
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def closest_multiset(lengths: list[tuple[int, int]], target: int) -> list[tuple[int, int]]:
    """(length, times) from (length, available) with the largest total of at most target.

    Bit s of a Python integer says that total s can be reached. An available count is split into powers of two, so that
    each step is one shift; the states before each step are kept, and walking back through them gives the counts."""
    reach, states = 1, []
    full = (1 << (target + 1)) - 1
    for length, available in lengths:
        left, part = min(available, target // length), 1
        while left:
            take = min(part, left)
            states.append((reach, length, take))
            reach |= (reach << (length * take)) & full
            left, part = left - take, part * 2
        if reach >> target & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for before, length, take in reversed(states):
        if not before >> total & 1:
            total -= length * take
            used[length] = used.get(length, 0) + take
    return sorted(used.items(), reverse=True)


def packing_plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """[(multiset of lengths, number of windows filled with it)], using up the whole histogram."""
    left = dict(sorted(histogram.items(), reverse=True))
    plan = []
    while left:
        longest = next(iter(left))
        left[longest] -= 1
        rest = closest_multiset([(n, c) for n, c in left.items() if c and n <= capacity - longest], capacity - longest)
        left[longest] += 1
        counts = dict(rest)
        counts[longest] = counts.get(longest, 0) + 1
        times = min(left[n] // c for n, c in counts.items())
        for n, c in counts.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
        plan.append((sorted(counts.items(), reverse=True), times))
    return plan


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, by_chunk: bool = True) -> DataFrame:
    """One row for each piece of each document: where it starts, its length, and the crc of its ids."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path, by_chunk)
        for ids, texts in slices(batches):
            rows = []
            for doc_id, tokens in zip(ids.tolist(), encoder.encode(texts), strict=True):
                tokens += end
                n = len(tokens) // 4
                for start in range(0, n, capacity):
                    piece = tokens[4 * start : 4 * (start + capacity)]
                    rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), n))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        encoder.forget()
        release()

    return whole_texts(docs).mapInArrow(cut, _PIECE)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, by_chunk: bool = True) -> DataFrame:
    """Where each piece of each document goes: the piece's columns, sequence_id and offset in that sequence."""
    pieces = Written(token_pieces(docs, path or tokenizer_path(), capacity, end_id, by_chunk), "pieces").df
    short = pieces.where(F.col("length") < capacity)
    histogram = {r["length"]: r["n"] for r in short.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity - 1 rows
    plan = packing_plan(histogram, capacity)

    # The pieces of one length, by rank, are dealt to the plan's multisets in order: keys[i] is the first rank of a run.
    wide = 1 << 40
    runs, seen, windows = [], dict.fromkeys(histogram, 0), 0
    for multiset, times in plan:
        offset = 0
        for length, count in multiset:
            runs.append((length * wide + seen[length], windows, count, offset, length))
            seen[length] += count * times
            offset += length * count
        windows += times
    runs.sort()
    keys, window, each, offsets, lengths = (np.array(c, np.int64) for c in zip(*runs, strict=True)) if runs else (np.empty(0, np.int64),) * 5

    @tidy
    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pieces in frames:
            key = pieces["length"].to_numpy() * wide + pieces["rank"].to_numpy()
            i = np.searchsorted(keys, key, "right") - 1
            nth = key - keys[i]
            yield pieces.drop(columns="rank").assign(sequence_id=window[i] + nth // each[i], offset=offsets[i] + nth % each[i] * lengths[i])

    packed = numbered(short, ["length"], "doc_id", "rank", max(histogram.values(), default=1)).select(*pieces.columns, "rank").mapInPandas(place, _PIECE + ", sequence_id long, offset long")
    full_pieces = pieces.where(F.col("length") == capacity).count()
    full = numbered(pieces.where(F.col("length") == capacity).withColumn("__key", F.struct("doc_id", "start")), [], "__key", "sequence_id", full_pieces)
    return packed.unionByName(full.drop("__key").withColumn("sequence_id", F.col("sequence_id") + windows).withColumn("offset", F.lit(0).cast("long")))


def sequences(docs: DataFrame, packed: DataFrame, path: str | None = None, end_id: int = END_ID, by_chunk: bool = True) -> DataFrame:
    """The packed ids themselves: sequence_id and input_ids (little-endian unsigned 32-bit), for training readers."""
    path, end = path or tokenizer_path(), np.array([end_id], "<u4").tobytes()

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path, by_chunk)
        for batch in batches:
            out = []
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            for tokens, pieces in zip(encoder.encode(texts), batch.column("pieces").to_pylist(), strict=True):
                tokens += end
                out += [(p["sequence_id"], p["offset"], tokens[4 * p["start"] : 4 * (p["start"] + p["length"])]) for p in pieces]
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["sequence_id", "offset", "ids"])

    pieces = packed.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    parts = whole_texts(docs).join(pieces, "doc_id").select("text", "pieces").mapInArrow(take, "sequence_id long, offset long, ids binary")
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return parts.groupBy("sequence_id").agg(joined(ordered).alias("input_ids"))
