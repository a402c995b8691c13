"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

A shingle is five consecutive words (runs of 0-9, a-z and non-ASCII bytes after lower-casing A-Z); a text of one to four words is one
shingle. Its weight in a text is (1 + ln times) x idf.

With `rising` (op4 and the pipeline) idf follows the document count of every shingle, (1 + ln((1 + N) / (1 + n))) over what that is for
n = 1. All shingles are counted by their highest 56 bits: buckets of documents send groups of fingerprints what they
hold, packed, and get back the counts of those that several documents hold (mail.py). Signatures and comparisons use these counts.

Without it, idf is 1 for shingles in up to COMMON_SHARE of the documents (or COMMON_LEAST) and falls with the logarithm of the share beyond
that. Then only the shingles that fall below 1 are counted one by one, exactly and over all documents: counts by two hashes
(CELLS cells each) rule nearly all others out whatever the slices that Spark reads, and there can be no more than 10 times the
shingles of a mean text of them.

Rising idf makes the few words that an edit puts in weigh more than what a large group of copies shares, so that its near copies
fall apart. With `edited` (op4 and the pipeline) pairs are therefore links, too, where the idf without `rising` makes them similar
and KEPT_WORDS of their words stand in common shingles. (A passage beside other words is no edited copy: as many shingles are common, but
fewer words.) Texts are signed and banded by both weights, so that such pairs meet like the others.

Texts of one word sequence are one class from the start; all else is about the classes' smallest doc_ids. A text has
SAMPLES consistent weighted samples: hash bits of (shingle, sample) choose one of 65,536 triples (r, c, beta) drawn once
from Gamma(2, 1), Gamma(2, 1) and uniform, t = floor(ln weight / r + beta), and the shingle with the smallest
ln c - r (t - beta) - r gives the sample (shingle, t). Equal samples have the weighted Jaccard similarity as probability.
BANDS bands of ROWS samples put texts into buckets; a pair of similarity 0.8 meets in one with probability 0.9994.

In a bucket all texts are compared with the smallest doc_id. Where that leaves several components in a bucket, pairs of
texts of two components are compared inside tasks by what their signatures say: total weights further apart than the
similarity allows, or so few equal samples as a pair of similarity 0.8 has once in ten thousand times, rule a pair out. What is
left is compared by the texts, each pair once, in the first band that it shares. A bucket's largest component is never
compared with itself, and buckets above BLOCK texts are cut into blocks that meet two and two. So no group of copies is
spread out into pairs, and links are exact.

Texts without words (null, empty, only punctuation) are like nothing and are kept. Rows that repeat a doc_id are one
document, whose text is the smallest of theirs; rows without doc_id get no class. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseframe.llm import mail
from caseframe.llm.common import NOT_ALNUM, Words, Written, drop_all, group_slices, mix, one_text_each, release, sequence_digests, shuffle_width, slices, tidy
from caseframe.llm.graph import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 14, 4
SAMPLES = BANDS * ROWS
#: Texts of a bucket that a task compares with as many others.
BLOCK, MASS = 2048, 1_000_000
#: Share of the documents, and number of them, up to which a shingle has idf 1.
COMMON_SHARE, COMMON_LEAST = 0.1, 50
#: Share of the words of two texts that stand in common shingles of edited copies.
KEPT_WORDS = 0.85

_draw = np.random.Generator(np.random.PCG64(20100614))
_R, _C, _BETA = _draw.gamma(2, 1, 1 << 16), _draw.gamma(2, 1, 1 << 16), _draw.random(1 << 16)
_LN_C = np.log(_C)
#: The triples are numbered by their ln a for weight 1, so that a number is its own rank.
_by_rank = np.argsort(_LN_C + _R * _BETA - _R, kind="stable")
_R, _BETA, _LN_C = _R[_by_rank], _BETA[_by_rank], _LN_C[_by_rank]
_SORTED = _LN_C + _R * _BETA - _R
_LOW, _MOST = np.uint64((1 << 48) - 1), np.uint64((1 << 64) - 1)
_TOP = np.uint64(48)
#: A bound of ln a of each triple for weight 1, with room for rounding, and the largest ln a of each rank.
_LEAST_LN_A, _UP_TO = _LN_C - _R - 1e-9, np.append(_SORTED[:-1], np.inf)
_FACTORS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64)) | np.uint64(1)


class Shingles:
    """The shingles of some texts: fingerprints, the text of each, and where each text's begin (texts without any left out)."""

    def __init__(self, texts: list[bytes]):
        self.words = Words([t.lower() for t in texts], NOT_ALNUM)
        first, hashes = self.words.windows(SHINGLE)
        of = self.words.text_of[first]
        size = np.diff(self.words.first)
        short = np.flatnonzero((size > 0) & (size < SHINGLE))
        if len(short):
            more = sequence_digests(self.words.hashes, self.words.first[short], self.words.first[short + 1])
            order = np.argsort(np.concatenate([of, short]), kind="stable")
            of, hashes = np.concatenate([of, short])[order], np.concatenate([hashes, more])[order]
        self.hashes, self.of = hashes, of

    @cached_property
    def times(self) -> np.ndarray:
        """How often each shingle occurs in its text."""
        both = self.hashes ^ mix(self.of.astype(np.uint64) + np.uint64(1))
        ordered = np.sort(both)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        times = np.ones(len(both))
        if len(twice):
            at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, both), len(twice) - 1)] == both)
            _, which, n = np.unique(both[at], return_inverse=True, return_counts=True)
            times[at] = n[which]
        return times


class Idf:
    """Idf of the shingles that more than `least` documents hold; all others have 1."""

    def __init__(self, hashes: np.ndarray, docs: np.ndarray, total: int):
        self.total, self.least = total, max(COMMON_SHARE * total, COMMON_LEAST)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.idf = np.minimum(1.0, np.log1p(total / docs[order]) / np.log1p(total / self.least)) if total else docs.astype(float)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes))
        if len(self.hashes) and len(hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            there = self.hashes[at] == hashes
            out[there] = self.idf[at[there]]
        return out


def rising_idf(docs: np.ndarray, total: int) -> np.ndarray:
    """Idf by the number of documents that hold each shingle: 1 for one, less for more."""
    return (1 + np.log((1 + total) / (1 + docs))) / (1 + np.log((1 + total) / 2))


def flat_idf(docs: np.ndarray, total: int) -> np.ndarray:
    """Idf's values from counts of all shingles: 1 for up to a share of the documents, less for more."""
    least = max(COMMON_SHARE * total, COMMON_LEAST)
    return np.minimum(1.0, np.log1p(total / np.maximum(docs, least)) / np.log1p(total / least))


def weights(shingles: Shingles, idf: Idf, docs: np.ndarray | None = None, flat: bool = False) -> np.ndarray:
    """The weight of each shingle; docs: the number of documents that hold it, where all were counted."""
    return (1 + np.log(shingles.times)) * (idf.of(shingles.hashes) if docs is None else (flat_idf if flat else rising_idf)(docs, idf.total))


def _presence(shingles: Shingles) -> np.ndarray:
    """The shingles of all texts, each once a text."""
    again = np.flatnonzero(shingles.times > 1)
    both = shingles.hashes[again] ^ mix(shingles.of[again].astype(np.uint64) + np.uint64(1))
    _, first = np.unique(both, return_index=True)
    return np.concatenate([shingles.hashes[shingles.times == 1], shingles.hashes[again[first]]])


#: Cells of each of the two hashes, and the groups that add them up.
CELLS, COUNTERS = 1 << 19, 8


def _cells(hashes: np.ndarray) -> list[np.ndarray]:
    return [(hashes >> np.uint64(shift)).astype(np.int64) & (CELLS - 1) for shift in (4, 36)]


def _summed(table: pa.Table) -> pa.Table:
    """The sum of packed arrays of counts."""
    total = sum(np.frombuffer(mail.stretch(p.as_py()), "<u4").astype(np.int64) for p in table.column("payload"))
    return table.slice(0, 1).set_column(1, "payload", pa.array([mail.squeeze(total.astype("<u8").tobytes())], pa.binary()))


_COUNTS = "grp int, payload binary"


def count_common(texts: DataFrame) -> Idf:
    """Idf from exact document counts of the shingles in more than COMMON_SHARE of the documents.

    A shingle's two cells hold at least its own documents, so that shingles with a cell below the share are ruled out. texts:
    doc_id and text."""
    each = 2 * CELLS // COUNTERS

    @tidy
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(2 * CELLS, np.int64), 0
        for ids, part in slices(batches):
            n += len(ids)
            for k, cell in enumerate(_cells(_presence(Shingles(part)))):
                counts[k * CELLS : (k + 1) * CELLS] += np.bincount(cell, minlength=CELLS)
        if n:
            packed = [mail.squeeze(counts[c * each : (c + 1) * each].astype("<u4").tobytes()) for c in range(COUNTERS)]
            packed.append(mail.squeeze(np.array([n], "<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(COUNTERS + 1, dtype=np.int32)), pa.array(packed, pa.binary())], ["grp", "payload"])

    # COUNTERS + 1 rows
    summed = {r["grp"]: np.frombuffer(mail.stretch(bytes(r["payload"])), "<u8") for r in texts.mapInArrow(cells, _COUNTS).groupBy("grp").applyInArrow(_summed, _COUNTS).collect()}
    total = int(summed[COUNTERS][0]) if summed else 0
    least = max(COMMON_SHARE * total, COMMON_LEAST)
    many = np.concatenate([summed[c] for c in range(COUNTERS)]).reshape(2, CELLS) > least if summed else np.zeros((2, CELLS), bool)
    if not many.any(1).all():
        return Idf(np.empty(0, np.uint64), np.empty(0), total)

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.empty(0, np.uint64), np.empty(0, np.int64)
        for _, part in slices(batches):
            own = _presence(Shingles(part))
            a, b = _cells(own)
            both = np.concatenate([found, own[many[0][a] & many[1][b]]])
            weight = np.concatenate([n, np.ones(len(both) - len(found), np.int64)])
            found, which = np.unique(both, return_inverse=True)
            n = np.bincount(which, weight, len(found)).astype(np.int64)
        rows = []
        for g, at in group_slices((found >> np.uint64(60)).astype(np.int64)):
            payload = mail.pack_sorted(found[at])
            rows.append((g, len(payload).to_bytes(4, "little") + payload + mail.planes(n[at])))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["grp", "payload"])

    def add(table: pa.Table) -> pa.Table:
        """The counts of all tasks; what none of two cells rules out is bounded by the shingles of a few texts."""
        found, n = [], []
        for packed in table.column("payload").to_pylist():
            cut = 4 + int.from_bytes(packed[:4], "little")
            found.append(mail.unpack_sorted(packed[4:cut]))
            n.append(mail.unplanes(packed[cut:], "<i8"))
        found, which = np.unique(np.concatenate(found), return_inverse=True)
        n = np.bincount(which, np.concatenate(n), len(found))
        return pa.table([pa.array(found[n > least].view(np.int64)), pa.array(n[n > least])], ["shingle", "n"])

    counts = texts.mapInArrow(count, _COUNTS).groupBy("grp").applyInArrow(add, "shingle long, n double").toPandas()
    return Idf(counts["shingle"].to_numpy(np.int64).view(np.uint64), counts["n"].to_numpy(float), total)


def _ln_a(ln: np.ndarray, triple: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(t, ln a) for weights by their logarithms and triples."""
    t = np.floor(ln / _R[triple] + _BETA[triple])
    return t, _LN_C[triple] - _R[triple] * (t - _BETA[triple]) - _R[triple]


def _drawn(ln: np.ndarray, triple: np.ndarray) -> np.ndarray:
    """For weights by their logarithms and triples: the rank of ln a in the top 16 bits, and below it what t turns the shingle's own
    bits into."""
    t, ln_a = _ln_a(ln, triple)
    rank = np.searchsorted(_SORTED, ln_a).astype(np.uint64)
    turn = np.where(t == 0, np.uint64(0), mix(t.astype(np.int64).view(np.uint64)))
    return (np.minimum(rank, np.uint64(65535)) << np.uint64(48)) | (turn & _LOW)


#: Weights for which _drawn() is kept for all triples (512 kB each): 1, and those that MANY shingles of some slice have.
WEIGHTS_KEPT, MANY = 8, 512
_KEPT = np.empty(WEIGHTS_KEPT << 16, np.uint64)
_KEPT[: 1 << 16] = np.arange(1 << 16, dtype=np.uint64) << _TOP
_row_of = {1.0: 0}


def _kept_rows(weight: np.ndarray) -> np.ndarray:
    """The row of each weight in _KEPT, -1 where it has none. Rows are filled as weights come; what they hold does not depend on it."""
    values, n = np.unique(weight, return_counts=True)
    for i in np.argsort(-n)[: np.count_nonzero(n >= MANY)].tolist():
        value = float(values[i])
        if value not in _row_of and len(_row_of) < WEIGHTS_KEPT:
            at = len(_row_of) << 16
            _KEPT[at : at + (1 << 16)] = _drawn(np.log(value), np.arange(1 << 16))
            _row_of[value] = at >> 16
    kept = np.array(sorted(_row_of))
    at = np.minimum(np.searchsorted(kept, weight), len(kept) - 1)
    return np.where(kept[at] == weight, np.array([_row_of[v] for v in kept.tolist()])[at], -1)


#: A text's first look is at shingles whose bound is below what its smallest ln a exceeds with probability e^-LOOK.
LOOK = 6.0


class _Drawing:
    """Some shingles of a slice, by text, all of weight 1 at most or all above: the smallest keys for one sample after the other.

    A key has the rank of ln a in its top 16 bits. The shingle's own hash bits are its key for weight 1; a smaller weight has no smaller
    rank, and a larger weight no larger one."""

    def __init__(self, hashes: np.ndarray, of: np.ndarray, weight: np.ndarray, texts: int):
        self.hashes, self.of, self.ln = hashes, of, np.log(weight)
        self.row = np.zeros(len(weight), np.int64)
        other = np.flatnonzero(weight != 1)
        self.row[other] = _kept_rows(weight[other])
        self.first = np.searchsorted(of, np.arange(texts + 1))
        self.there = np.flatnonzero(np.diff(self.first))
        self.z = np.empty_like(hashes)

    def lower(self, least: np.ndarray, at: np.ndarray) -> None:
        """Puts the keys of the shingles at these places into each text's least."""
        if len(at):
            z = self.z[at]
            triple, row = (z >> _TOP).astype(np.int64), self.row[at]
            key = np.empty_like(z)
            kept = row >= 0
            key[kept] = _KEPT[(row[kept] << 16) | triple[kept]]
            key[~kept] = _drawn(self.ln[at[~kept]], triple[~kept])
            np.minimum.at(least, self.of[at], key ^ (z & _LOW))

    def light(self, least: np.ndarray, at: np.ndarray, bound: np.ndarray) -> None:
        """lower() for weights of 1 at most. Most keys are those of weight 1; of the others only what may be the smallest is drawn."""
        z, of = self.z[at], self.of[at]
        triple = (z >> _TOP).astype(np.int64)
        same = self.ln[at] / _R[triple] + _BETA[triple] >= 0
        np.minimum.at(least, of[same], z[same])
        rest = np.flatnonzero(~same)
        rest = rest[z[rest] >> _TOP <= np.minimum(least, bound)[of[rest]] >> _TOP]
        self.lower(least, at[rest])

    def heavy(self, least: np.ndarray, bound: np.ndarray) -> None:
        """lower() for weights above 1: ln a is no less than _LEAST_LN_A - ln weight, and only what may be the smallest is ranked."""
        if len(self.of):
            up_to, triple = _UP_TO[(np.minimum(least, bound) >> _TOP).astype(np.int64)], (self.z >> _TOP).astype(np.int64)
            at = np.flatnonzero(_LEAST_LN_A[triple] - self.ln <= up_to[self.of])
            self.lower(least, at[_ln_a(self.ln[at], triple[at])[1] <= up_to[self.of[at]]])


def samples(shingles: Shingles, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts that have shingles, their samples as an array of texts x SAMPLES 48-bit values)."""
    begins = np.flatnonzero(np.concatenate([[True], shingles.of[1:] != shingles.of[:-1]])) if len(shingles.of) else np.empty(0, np.int64)
    texts = len(begins)
    out = np.empty((texts, SAMPLES), np.uint64)
    if not texts:
        return begins, out
    of = np.repeat(np.arange(texts), np.diff(np.append(begins, len(weight))))
    light, heavy = (_Drawing(shingles.hashes[at], of[at], weight[at], texts) for at in (np.flatnonzero(weight <= 1), np.flatnonzero(weight > 1)))
    last = np.minimum(-np.expm1(-LOOK / np.add.reduceat(weight / shingles.times, begins)) * 65536, 65535).astype(np.uint64)
    look = ((last << _TOP) | _LOW)[light.of]
    near = np.empty(len(look), bool)
    for k, factor in enumerate(_FACTORS):
        least, bound = np.full(texts, _MOST), np.full(texts, _MOST)
        np.multiply(heavy.hashes, factor, out=heavy.z)
        if len(heavy.there):
            bound[heavy.there] = np.minimum.reduceat(heavy.z, heavy.first[heavy.there])
        np.multiply(light.hashes, factor, out=light.z)
        np.less_equal(light.z, look, out=near)
        light.light(least, np.flatnonzero(near), bound)
        heavy.heavy(least, bound)
        for i in np.flatnonzero((least >> _TOP > last) & (last < 65535)).tolist():  # one text in e^LOOK: all its shingles
            light.light(least, np.arange(light.first[i], light.first[i + 1]), least)
        out[:, k] = least & _LOW
    return shingles.of[begins], out


def band_keys(sampled: np.ndarray, before: int = 0) -> np.ndarray:
    """texts x BANDS fingerprints of ROWS samples each; bands are numbered after those before."""
    out = np.empty((len(sampled), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            key = np.full(len(sampled), before + b + 1, np.uint64)
            for r in range(ROWS):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sampled[:, b * ROWS + r])
            out[:, b] = key
    return out


_SIGNED = "doc_id long, print long, print2 long, bands array<long>, samples binary, weight double, flat double, held binary"


def _signatures(ids: np.ndarray, texts: list[bytes], idf: Idf, counted: Callable[[np.ndarray], np.ndarray] | None = None, edited: bool = False) -> pa.RecordBatch:
    shingles = Shingles(texts)
    docs = None if counted is None else counted(shingles.hashes)
    weight = weights(shingles, idf, docs)
    have, sampled = samples(shingles, weight)
    total = np.bincount(shingles.of, weight / shingles.times, len(texts))[have]
    keys, flat = band_keys(sampled), pa.nulls(len(have), pa.float64())
    if edited:
        weight = weights(shingles, idf, docs, flat=True)
        more = samples(shingles, weight)[1]
        sampled, keys = np.concatenate([sampled, more], 1), np.concatenate([keys, band_keys(more, BANDS)], 1)
        flat = pa.array(np.bincount(shingles.of, weight / shingles.times, len(texts))[have])
    first, hashes = shingles.words.first, shingles.words.hashes
    prints = np.stack([sequence_digests(hashes, first[have], first[have + 1], seed) for seed in (2, 3)], 1)
    keys = np.ascontiguousarray(keys).view(np.int64)
    values = pa.ListArray.from_arrays(pa.array(np.arange(len(have) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
    short = [row.tobytes() for row in sampled.astype("<u4")]
    held = [None] * len(have) if docs is None else [mail.planes(d) for d in np.split(docs.astype("<u4"), np.searchsorted(shingles.of, have[1:]))][: len(have)]
    columns = [pa.array(ids[have], pa.int64()), pa.array(prints[:, 0].view(np.int64)), pa.array(prints[:, 1].view(np.int64)), values, pa.array(short, pa.binary()), pa.array(total), flat, pa.array(held, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "print", "print2", "bands", "samples", "weight", "flat", "held"])


def _signed(texts: DataFrame, idf: Idf) -> DataFrame:
    """doc_id, print (of the word sequence; texts without words are left out), bands, samples (32 bits of each), weight, flat
    (the weight of edited copies) and held (the document count of each shingle in its order, where all were counted)."""

    @tidy
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, part in slices(batches, 1 << 20):
            yield _signatures(ids, part, idf)

    return texts.mapInArrow(sign, _SIGNED)


def _parts(texts: list[bytes], most: int = 1 << 20) -> Iterator[slice]:
    """A few MB of text at once, or one text."""
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) <= most):
            size += len(texts[end])
            end += 1
        yield slice(begin, end)
        begin = end


def _key_counts(found: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of each one's numbers."""
    keys, n = np.concatenate(found), np.concatenate(n)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n[order], first) if len(first) else np.empty(0, np.int64)


def _letter(keys: np.ndarray, n: np.ndarray) -> bytes:
    packed = mail.pack_sorted(keys)
    return len(packed).to_bytes(4, "little") + packed + mail.planes(n.astype("<u4"))


def _opened(letter: bytes) -> tuple[np.ndarray, np.ndarray]:
    cut = 4 + int.from_bytes(letter[:4], "little")
    return mail.unpack_sorted(letter[4:cut]), mail.unplanes(letter[cut:], "<u4").astype(np.int64)


#: Bits of a fingerprint that counting leaves out.
CUT = np.uint64(8)


def _signed_by_counts(texts: DataFrame, unit: int = mail.UNIT, edited: bool = False) -> tuple[DataFrame, Idf]:
    """_signed() by the document counts of all shingles, and the idf that goes with them."""
    own, idf = mail.bucketed(texts, unit=unit), Idf(np.empty(0, np.uint64), np.empty(0), texts.count())
    groups = own.buckets

    def ask(table: pa.Table) -> pa.Table:
        bucket, whole = table.column("bucket")[0].as_py(), mail.ordered(table)[1]
        found = [np.unique(_presence(Shingles(whole[part])) >> CUT, return_counts=True) for part in _parts(whole)]
        keys, n = _key_counts([k for k, _ in found], [n for _, n in found])
        group = ((keys >> np.uint64(24)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)
        return mail.mail_table([(bucket, 0, g, _letter(keys[at], n[at])) for g, at in group_slices(group)])

    def count(table: pa.Table) -> pa.Table:
        group = table.column("grp")[0].as_py()
        asked = [_opened(x) for x in table.column("payload").to_pylist()]
        keys, n = _key_counts([k for k, _ in asked], [n for _, n in asked])
        keys, n = keys[n > 1], n[n > 1]
        rows = []
        for bucket, (mine, _) in zip(table.column("bucket").to_pylist(), asked, strict=True):
            at = np.searchsorted(keys, mine)
            at = at[keys[np.minimum(at, len(keys) - 1)] == mine] if len(keys) else at[:0]
            if len(at):
                rows.append((bucket, 0, group, _letter(keys[at], n[at])))
        release()
        return mail.mail_table(rows)

    def sign(left: pa.Table, right: pa.Table) -> pa.Table:
        told = mail.letters(right)
        several = [_opened(told[k]) for k in sorted(told)]
        keys, n = (np.concatenate(x) for x in zip(*several, strict=True)) if several else (np.empty(0, np.uint64), np.empty(0, np.int64))

        def counted(hashes: np.ndarray) -> np.ndarray:
            docs = np.ones(len(hashes), np.int64)
            if len(keys):
                mine = hashes >> CUT
                order = np.argsort(mine)  # neighbours are looked up one after the other
                mine = mine[order]
                at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                there = keys[at] == mine
                docs[order[there]] = n[at[there]]
            return docs

        ids, whole, _ = mail.ordered(left)
        out = pa.Table.from_batches([_signatures(ids[part], whole[part], idf, counted, edited) for part in _parts(whole)] or [_signatures(ids, whole, idf, counted, edited)])
        release()
        return out

    told = own.texts.groupBy("bucket").applyInArrow(ask, mail.MAIL).groupBy("grp").applyInArrow(count, mail.MAIL)
    return own.texts.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(sign, _SIGNED), idf


def least_equal(least: float, prune: bool = True) -> int:
    """The number of equal samples that a pair of this similarity falls short of once in ten thousand times or less; with
    prune=False no number of samples rules a pair out."""
    return not prune and -1 or max(1, int(least * SAMPLES - 3.6 * (SAMPLES * least * (1 - least)) ** 0.5))


def _rows(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The largest weighted Jaccard similarity that two total weights allow."""
    return np.minimum(a, b) / np.maximum(a, b)


def _may_be(equal: np.ndarray, weight: np.ndarray, flat: np.ndarray, least: float, prune: bool) -> np.ndarray:
    """Whether signatures leave it open that pairs are similar enough by one of their weights. equal: which samples are; weight and flat:
    the ratios that the total weights allow (null without a second signature)."""
    good = (equal[:, :SAMPLES].sum(1) >= least_equal(least, prune)) & (weight >= least - 1e-9)
    if equal.shape[1] > SAMPLES:
        good |= (equal[:, SAMPLES:].sum(1) >= least_equal(least, prune)) & (flat >= least - 1e-9)
    return good


def _likely(pairs: DataFrame, classes: DataFrame, least: float, prune: bool) -> DataFrame:
    """The pairs (a, b) that their signatures do not rule out."""

    @tidy
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            equal = _rows(batch.column("sa"), "<u4") == _rows(batch.column("sb"), "<u4") if batch.num_rows else np.empty((0, SAMPLES), bool)
            good = _may_be(equal, *(_ratio(*(batch.column(c).to_numpy(zero_copy_only=False) for c in x)) for x in (("wa", "wb"), ("fa", "fb"))), least, prune)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    own = lambda x: classes.select(F.col("rep").alias(x), F.col("samples").alias(f"s{x}"), F.col("weight").alias(f"w{x}"), F.col("flat").alias(f"f{x}"))
    return pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", "sa", "sb", "wa", "wb", "fa", "fb").mapInArrow(keep, "a long, b long")


#: A document (rep) that a block's pairs need, or the pairs themselves (a and b, packed).
_MET = "bucket long, left int, right int, rep long, a binary, b binary"
_KEY = ["bucket", "left", "right"]


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """The rows of each key, from batches that are sorted by it."""
    waiting: list[pa.RecordBatch] = []
    last: tuple[int, ...] | None = None
    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy() for k in _KEY], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)] if len(keys) else [0]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(keys[begin].tolist())
            if waiting and now != last:
                yield last, pa.Table.from_batches(waiting).combine_chunks()
                waiting = []
            last = now
            waiting.append(batch.slice(begin, end - begin))
    if waiting:
        yield last, pa.Table.from_batches(waiting).combine_chunks()


def _across(open_: DataFrame, least: float, prune: bool) -> DataFrame:
    """Pairs of two components that meet in a bucket and that their signatures do not rule out, each once.

    open_: bucket, left, right (the blocks that meet), block, rep, component, samples, weight, flat, bands."""

    def meet(key: tuple[int, ...], group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        bucket, left, right = key
        rep, component, weight, block = (group.column(c).to_numpy() for c in ("rep", "component", "weight", "block"))
        flat = group.column("flat").to_numpy(zero_copy_only=False)
        sampled = _rows(group.column("samples"), "<u4")
        bands = np.array(group.column("bands").to_pylist(), np.int64)
        a, b = np.flatnonzero(block == left), np.flatnonzero(block == right)
        found = [np.empty((2, 0), np.int64)]
        for at in range(0, len(a), 256):
            some = a[at : at + 256]
            near = [_ratio(w[some][:, None], w[b]) >= least - 1e-9 for w in (weight, flat)]  # null is not near
            other = (component[some][:, None] != component[b]) & (near[0] | near[1])
            if left == right:
                other &= some[:, None] < b
            i, j = np.nonzero(other)
            i, j = some[i], b[j]
            for k in range(0, len(i), 65536):
                x, y = i[k : k + 65536], j[k : k + 65536]
                good = _may_be(sampled[x] == sampled[y], _ratio(weight[x], weight[y]), _ratio(flat[x], flat[y]), least, prune)
                x, y = x[good], y[good]
                shared = bands[x] == bands[y]
                mine = bands[x, shared.argmax(1)] == bucket
                found.append(np.stack([rep[x[mine]], rep[y[mine]]]))
        return tuple(np.concatenate(found, 1))

    @tidy
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in _by_key(batches):
            a, b = meet(key, group)
            if len(a):
                reps = np.unique(np.concatenate([a, b]))
                n = len(reps) + 1
                columns = [pa.array([k] * n, t) for k, t in zip(key, (pa.int64(), pa.int32(), pa.int32()), strict=True)]
                packed = [pa.array([None] * (n - 1) + [x.astype("<i8").tobytes()], pa.binary()) for x in (a, b)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([*reps.tolist(), None], pa.int64()), *packed], [*_KEY, "rep", "a", "b"])

    dealt = open_.repartition(shuffle_width(open_.sparkSession), *_KEY).sortWithinPartitions(*_KEY)
    return dealt.mapInArrow(look, _MET)


class Vectors:
    """The distinct shingles of some texts with their weights, text after text."""

    def __init__(self, texts: list[bytes], idf: Idf, docs: list[np.ndarray] | None = None, flat: bool = False):
        hashes, weight, sizes = [], [], []
        for part in _parts(texts):
            shingles = Shingles(texts[part])
            order = np.lexsort((shingles.hashes, shingles.of))
            h, of = shingles.hashes[order], shingles.of[order]
            first = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])]) if len(h) else np.empty(0, bool)
            hashes.append(h[first])
            weight.append(weights(shingles, idf, docs and np.concatenate(docs[part]), flat)[order][first])
            sizes.append(np.bincount(of[first], minlength=part.stop - part.start))
        self.weight = np.concatenate(weight)
        self.distinct, self.number = np.unique(np.concatenate(hashes), return_inverse=True)
        self.starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        self.total = np.array([self.weight[a:z].sum() for a, z in zip(self.starts[:-1], self.starts[1:], strict=True)])

    def similarities(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Weighted Jaccard similarity of texts a and b, pair by pair; a text's weights are laid out once for all its pairs."""
        out, full = np.zeros(len(a)), np.zeros(len(self.distinct))
        order = np.argsort(a, kind="stable")
        for x, part in group_slices(a[order]):
            mine = slice(self.starts[x], self.starts[x + 1])
            full[self.number[mine]] = self.weight[mine]
            for at in range(part.start, part.stop, 512):
                pairs = order[at : min(at + 512, part.stop)]
                begins, sizes = self.starts[b[pairs]], self.starts[b[pairs] + 1] - self.starts[b[pairs]]
                offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                entries = np.arange(sizes.sum()) + np.repeat(begins - offsets, sizes)
                shared = np.add.reduceat(np.minimum(full[self.number[entries]], self.weight[entries]), offsets)
                out[pairs] = shared / (self.total[x] + self.total[b[pairs]] - shared)
            full[self.number[mine]] = 0
        return out


def kept_words(a: bytes, b: bytes) -> float:
    """The share of two texts' words that stand in shingles of both, each word once."""
    shingles, sizes = Shingles([a, b]), []
    own = [shingles.hashes[shingles.of == k] for k in (0, 1)]
    words = np.diff(shingles.words.first)
    for k in (0, 1):
        at, step = np.flatnonzero(np.isin(own[k], own[1 - k])), np.zeros(words[k] + 1, np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, np.minimum(at + SHINGLE, words[k]), -1)
        sizes.append(np.count_nonzero(np.cumsum(step)))
    both = min(sizes)
    return both / max(words.sum() - both, 1)


def _docs(held: list[bytes | None]) -> list[np.ndarray] | None:
    """The document counts of texts' shingles, where all were counted."""
    return None if None in held else [mail.unplanes(h, "<u4") for h in held]


def _verified_blocks(met: DataFrame, texts: DataFrame, idf: Idf, least: float, edited: bool = False) -> DataFrame:
    """The packed pairs of _across() whose texts are similar enough, as rows (a, b). A task gets the texts of a block's pairs
    once, however many pairs they are in."""
    needed = met.where("rep IS NOT NULL").hint("merge").join(texts.withColumnRenamed("doc_id", "rep"), "rep").select(*_KEY, "rep", F.encode("text", "UTF-8").alias("a"), F.col("held").alias("b"))
    rows = needed.unionByName(met.where("rep IS NULL")).repartition(shuffle_width(met.sparkSession), *_KEY).sortWithinPartitions(*_KEY, "rep")

    @tidy
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _by_key(batches):
            own = group.filter(pa.compute.is_valid(group.column("rep")))
            reps = own.column("rep").to_numpy()
            pairs = group.filter(pa.compute.is_null(group.column("rep")))
            a, b = (np.frombuffer(b"".join(pairs.column(c).to_pylist()), "<i8") for c in "ab")
            x, y = np.searchsorted(reps, a), np.searchsorted(reps, b)
            whole, docs = own.column("a").to_pylist(), _docs(own.column("b").to_pylist())
            good = Vectors(whole, idf, docs).similarities(x, y) >= least - 1e-9
            if edited and not good.all():
                rest = np.flatnonzero(~good)
                rest = rest[Vectors(whole, idf, docs, flat=True).similarities(x[rest], y[rest]) >= least - 1e-9]
                good[rest] = [kept_words(whole[x[i]], whole[y[i]]) >= KEPT_WORDS for i in rest]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[good]), pa.array(np.maximum(a, b)[good])], ["a", "b"])

    return rows.mapInArrow(check, "a long, b long")


def _blocks(own: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """The buckets (bucket, rep, component, cost) that hold several components, as blocks that meet. A text costs one, and more
    where it has more than MASS / BLOCK shingles; a block holds texts of `size` together."""
    sizes = own.groupBy("bucket", "component").agg(F.sum("cost").alias("n"))
    split = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("several")).where("several > 1")
    split = split.select("bucket", F.col("main.component").alias("main"), F.col("main.n").alias("n_main"), "total")
    number = lambda n: F.greatest(F.ceil(n / size), F.lit(1)).cast("int")
    placed = own.join(split, "bucket").withColumn("mains", number(F.col("n_main"))).withColumn("others", number(F.col("total") - F.col("n_main")))
    whole, main = F.col("total") <= size, F.col("component") == F.col("main")
    deal = lambda n: F.pmod(F.xxhash64("rep", "bucket"), n).cast("int")
    block = F.when(whole, 0).when(main, deal(F.col("mains"))).otherwise(F.col("mains") + deal(F.col("others")))
    facing = F.when(whole, F.array(F.lit(0))).when(main, F.sequence(F.col("mains"), F.col("mains") + F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("mains") + F.col("others") - 1))
    placed = placed.withColumn("block", block).withColumn("facing", F.explode(facing))
    placed = placed.select("bucket", F.least("block", "facing").alias("left"), F.greatest("block", "facing").alias("right"), "block", "rep", "component")
    return placed.join(classes.select("rep", "samples", "weight", "flat", "bands"), "rep")


def jaccard(left: list[bytes], right: list[bytes], idf: Idf, docs: list[np.ndarray] | None = None, flat: bool = False) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts."""
    n = len(left)
    shingles = Shingles(left + right)
    w = weights(shingles, idf, docs and np.concatenate(docs), flat)
    pair, side = shingles.of % n, shingles.of >= n
    both = shingles.hashes ^ mix(pair.astype(np.uint64) + np.uint64(1))
    order = np.lexsort((side, both))
    both, side, w, pair = both[order], side[order], w[order], pair[order]
    first = np.concatenate([[True], (both[1:] != both[:-1]) | (side[1:] != side[:-1])]) if len(both) else np.empty(0, bool)
    both, w, pair = both[first], w[first], pair[first]
    match = np.flatnonzero(both[1:] == both[:-1])
    shared = np.bincount(pair[match], np.minimum(w[match], w[match + 1]), n)
    total = np.bincount(pair, w, n)
    return shared / np.maximum(total - shared, 1e-12)


#: Bits of the map that keeps texts which no bucket shares out of the shuffle; at most 262,144 rows are broadcast.
MAP_BITS = 24


def _texts_of(ids: DataFrame, all_texts: DataFrame, signed: DataFrame | None) -> Written:
    """doc_id, text and held (from `signed`, else null) of the documents listed, and of few others. A bit map of hashed ids, of bounded
    size, drops most other documents as they are read, so that no text is shuffled for it; what it lets through by chance meets
    no pair later."""
    bits = 1 << min(MAP_BITS, max(12, (8 * ids.count()).bit_length()))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    words = ids.select(F.shiftright(slot, 6).alias("word"), F.expr("1L").alias("one"), (slot % 64).cast("int").alias("bit"))
    words = F.broadcast(words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("mask")))
    of = lambda df, *columns: df.withColumn("word", F.shiftright(slot, 6)).withColumn("bit", (slot % 64).cast("int")).join(words, "word").where(F.expr("shiftrightunsigned(mask, bit) & 1L = 1L")).select("doc_id", *columns)
    near = of(all_texts, "text")
    near = near.withColumn("held", F.lit(None).cast("binary")) if signed is None else near.hint("merge").join(of(signed, "held"), "doc_id")
    return Written(near, "bucket-texts", compression="zstd")


def _similar(left: list[bytes], right: list[bytes], idf: Idf, docs: list[np.ndarray] | None, least: float, edited: bool) -> np.ndarray:
    """Which pairs of texts are links."""
    good = jaccard(left, right, idf, docs) >= least - 1e-9
    if edited and not good.all():
        rest = np.flatnonzero(~good)
        some = lambda x: [x[i] for i in rest]
        rest = rest[jaccard(some(left), some(right), idf, some(docs) + some(docs[len(left) :]), flat=True) >= least - 1e-9]
        good[rest] = [kept_words(left[i], right[i]) >= KEPT_WORDS for i in rest]
    return good


def _verified(pairs: DataFrame, texts: DataFrame, idf: Idf, least: float, edited: bool = False) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""
    # One kind of join at every size, so that what is shuffled follows the input.
    own = lambda x, side: texts.select(F.col("doc_id").alias(x), F.col("text").alias(side), F.col("held").alias(f"held_{side}"))
    joined = pairs.hint("merge").join(own("a", "left"), "a").hint("merge").join(own("b", "right"), "b")

    @tidy
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 64):  # Python objects of a part of the batch at a time
                batch = whole.slice(begin, 64)
                left, right = ([t.encode() for t in batch.column(c).to_pylist()] for c in ("left", "right"))
                held = [batch.column(f"held_{c}").to_pylist() for c in ("left", "right")]
                a, b = (batch.column(c).to_numpy() for c in "ab")
                at = 0
                while at < len(left):
                    end, size = at, 0
                    while end < len(left) and (end == at or size + len(left[end]) + len(right[end]) <= 1 << 20):
                        size += len(left[end]) + len(right[end])
                        end += 1
                    good = _similar(left[at:end], right[at:end], idf, _docs(held[0][at:end] + held[1][at:end]), least, edited)
                    yield pa.RecordBatch.from_arrays([pa.array(a[at:end][good]), pa.array(b[at:end][good])], ["a", "b"])
                    at = end

    return joined.select("a", "b", "left", "right", "held_left", "held_right").mapInArrow(check, "a long, b long")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, block: int = BLOCK, prune: bool = True, rising: bool = False, unit: int = mail.UNIT, edited: bool = False) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its near duplicates, itself included) and kept (doc_id = class_id). rising: idf by the
    document count of every shingle. edited: with it, copies with a few edits however many copies share the rest."""
    edited = edited and rising
    every = one_text_each(docs)
    if rising:
        signed, idf = _signed_by_counts(every, unit, edited)
    else:
        idf = count_common(every)
        signed = _signed(every, idf)
    signed = Written(signed, "signatures")
    first = F.min_by(F.struct("bands", "samples", "weight", "flat"), "doc_id")
    classes = signed.df.groupBy("print", "print2").agg(F.min("doc_id").alias("rep"), first.alias("of"))
    classes = Written(classes.select("print", "print2", "rep", "of.*"), "classes")
    prints = Written(signed.df.select("doc_id", "print", "print2"), "prints").df
    cost = F.greatest(F.lit(1.0), F.greatest("weight", "flat") * BLOCK / MASS).alias("cost")
    placed = classes.df.select("rep", cost, F.explode("bands").alias("bucket"))
    several = placed.groupBy("bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("bucket", "low")
    buckets = Written(placed.join(several, "bucket"), "buckets")

    tested = buckets.df.where("rep <> low").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct()
    tested = Written(_likely(tested, classes.df, least, prune), "pairs")
    texts = _texts_of(buckets.df.select(F.col("rep").alias("doc_id")).distinct(), every, signed.df if rising else None)
    signed.drop()
    links = Written(_verified(tested.df, texts.df, idf, least, edited), "links")
    found = components(links.df)
    own = buckets.df.select("bucket", "rep", "cost").join(found.df.select(F.col("v").alias("rep"), "component"), "rep", "left")
    own = Written(own.select("bucket", "rep", "cost", F.coalesce("component", "rep").alias("component")), "bucket-components")
    across = Written(_across(_blocks(own.df, classes.df, block), least, prune), "pairs")
    more = None
    if not across.df.isEmpty():
        more = Written(_verified_blocks(across.df, texts.df, idf, least, edited), "links")
        found.drop()
        found = components(links.df.unionByName(more.df))
    rep = classes.df.select("rep", "print", "print2").join(found.df.select(F.col("v").alias("rep"), "component"), "rep", "left")
    rep = Written(rep.select("print", "print2", F.coalesce("component", "rep").alias("class_id")), "class-ids").df
    drop_all(classes, buckets, tested, texts, links, found, own, across, more)
    named = prints.join(rep, ["print", "print2"]).select("doc_id", "class_id")
    everyone = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct().join(named, "doc_id", "left")
    everyone = everyone.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return everyone.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def keep_one(docs: DataFrame, least: float = SIMILARITY, rising: bool = False, edited: bool = False) -> DataFrame:
    """The documents, with all their columns, without those that are near duplicates of a smaller doc_id; rows without doc_id stay."""
    others = near_duplicates(docs, least, rising=rising, edited=edited).where(~F.col("kept")).select("doc_id")
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)
