"""Quality by random Fourier features of document statistics, ridge regression on summed normal equations, isotonic calibration.

1. One look at whole texts writes STATISTICS, a few dozen figures of form (no words, no vocabulary), for each document.
2. Their means and deviations are taken over all documents; standardised figures are cut at EDGE deviations.
3. cos(W z + b) for FEATURES fixed random draws approximates a Gaussian kernel of width `width` between the figures of two documents.
4. Every labelled training row counts in the normal equations: each task adds up its rows, FOLDS sums apart, as the upper triangle
   of one matrix; sums are added FAN at a time, so that no task adds many and no sum grows with the rows.
5. Ridge weights are solved on the driver from FEATURES x FEATURES numbers: those of all folds, and for each fold those of the others.
6. Each training row's score by the weights of the other folds falls into one of BINS bins; pool-adjacent-violators over the bins
   gives a rising map from scores to shares of label 1, straight between the middles of its steps.

Training rows are those with crc32(doc_id as text) mod 5 other than 0 and a label; others only get scores. lang, source, doc_id and
labels are no inputs of a score. Null and empty texts have the figures of a text without bytes. Without labelled training rows of
both classes every score is the share of label 1 with one row of each added. Labels that are null or neither 0 nor 1 are left out;
of several labels of a doc_id the larger counts. Rows that repeat a doc_id are scored each for itself, and each counts as a training
row; rows without doc_id get no score. Other columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseframe.llm.common import Words, Written, slices, tidy, whole_texts

#: Figures of a document, in the order of their columns.
STATISTICS = (
    "bytes", "words", "word_length", "word_spread", "lower", "upper", "digits", "signs", "symbols", "marks", "stops", "commas", "letters",
    "lines", "line_spread", "signed_words", "capital_words", "blank_signs", "doubled_words", "distinct_words", "distinct_fives", "most_frequent", "distinct_lines", "entropy",
)
FEATURES = 256
FOLDS = 4
EDGE = 4.0
RIDGE = 1e-3
BINS = 1_024
FAN = 64
#: Labelled rows that one task adds up.
ROWS = 20_000
THRESHOLD = 0.3
_K = len(STATISTICS)
_SUMS = FEATURES * (FEATURES + 1) // 2 + FEATURES  # the upper triangle and the right side
#: Bins lie between these scores.
_LOW, _HIGH = -0.5, 1.5


def _class(characters: bytes | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


_LOWER, _UPPER, _DIGIT, _BEYOND = _class(range(97, 123)), _class(range(65, 91)), _class(range(48, 58)), _class(range(128, 256))
_SYMBOL = _class(b"#$%&*+/<=>@\\^_`{|}~[]")
_MARK, _STOP, _COMMA = _class(b"!?"), _class(b"."), _class(b",;:")
_SIGN = _class(range(33, 127)) & ~_LOWER & ~_UPPER & ~_DIGIT
_LETTER = _LOWER | _UPPER | _BEYOND


def _per_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive starts."""
    before = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return np.diff(before[starts])


def _distinct(keys: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, times of the most frequent one) of each of n texts."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    begins = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])]))
    most = np.zeros(n)
    np.maximum.at(most, of[begins], np.diff(np.append(begins, len(keys))).astype(float))
    return np.bincount(of[begins], minlength=n).astype(float), most


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of STATISTICS for each text."""
    n, words = len(texts), Words(texts)
    data, starts = np.frombuffer(words.buffer, np.uint8), words.text_starts
    # Each text ends with a newline of its own, which belongs to no figure.
    size = np.diff(starts) - 1.0
    least = np.maximum(size, 1)
    share = lambda mask: _per_text(mask[data], starts) / least
    count = np.diff(words.first).astype(float)
    some = np.maximum(count, 1)
    length = (words.ends - words.starts).astype(float)
    mean = _per_text(length, words.first) / some
    spread = np.sqrt(np.maximum(_per_text(length**2, words.first) / some - mean**2, 0))
    last, first = data[words.ends - 1], data[words.starts]
    letter = np.concatenate([[0], np.cumsum(_LETTER[data])])
    signed = (_SYMBOL | _MARK)[last] & _LETTER[first]
    capital = np.concatenate([[0], np.cumsum(_UPPER[data])])
    all_capital = (capital[words.ends] - capital[words.starts] >= 2) & (letter[words.ends] - letter[words.starts] == capital[words.ends] - capital[words.starts])
    blank = letter[words.ends] == letter[words.starts]
    doubled = np.concatenate([np.zeros(1, bool), (words.hashes[1:] == words.hashes[:-1]) & (words.text_of[1:] == words.text_of[:-1])])[: len(words.hashes)]
    distinct, most = _distinct(words.hashes, words.text_of, n)
    begins, fives = words.windows(5)
    distinct_fives, _ = _distinct(fives, words.text_of[begins], n)
    # Lines: spans between newlines.
    breaks = np.flatnonzero(data == 10)
    line_starts = np.concatenate([[0], breaks[:-1] + 1])
    line_text = np.searchsorted(starts, line_starts, "right") - 1
    line_length = (breaks - line_starts).astype(float)
    lines = np.bincount(line_text, minlength=n).astype(float)
    line_mean = np.bincount(line_text, line_length, n) / lines
    line_spread = np.sqrt(np.maximum(np.bincount(line_text, line_length**2, n) / lines - line_mean**2, 0))
    # A line's digest: its words' digests in order, from the differences of a running mixture.
    weight = words.hashes * (np.arange(len(words.hashes), dtype=np.uint64) - np.searchsorted(words.starts, line_starts)[np.searchsorted(line_starts, words.starts, "right") - 1].astype(np.uint64) + np.uint64(1)) if len(words.hashes) else words.hashes
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weight, dtype=np.uint64)])
    line_hash = sums[np.searchsorted(words.starts, breaks)] - sums[np.searchsorted(words.starts, line_starts)]
    distinct_lines, _ = _distinct(line_hash, line_text, n)
    entropy = np.empty(n)
    for i in range(n):
        p = np.bincount(data[starts[i] : starts[i + 1] - 1], minlength=256) / least[i]
        p = p[p > 0]
        entropy[i] = -(p * np.log(p)).sum()
    return np.column_stack([
        np.log1p(size), np.log1p(count), np.log1p(mean), np.log1p(spread), share(_LOWER), share(_UPPER), share(_DIGIT), share(_SIGN), share(_SYMBOL),
        share(_MARK), share(_STOP), share(_COMMA), share(_LETTER), np.log1p(lines), np.log1p(line_spread),
        _per_text(signed, words.first) / some, _per_text(all_capital, words.first) / some, _per_text(blank, words.first) / some, _per_text(doubled, words.first) / some,
        distinct / some, distinct_fives / np.maximum(count - 4, 1), most / some, distinct_lines / lines, entropy,
    ])


@tidy
def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in slices(batches):
        figures = statistics(texts)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c) for c in figures.T)], ["doc_id", *STATISTICS])


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


class Kernel:
    """Standardised figures to random Fourier features. The draws are fixed by `seed`; one feature is the constant."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, width: float = 1.5, seed: int = 20240307):
        draw = np.random.Generator(np.random.PCG64(seed))
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, np.inf)
        self.w = draw.standard_normal((_K, FEATURES - 1)) / (width * np.sqrt(_K))
        self.b = draw.uniform(0, 2 * np.pi, FEATURES - 1)

    def __call__(self, figures: np.ndarray) -> np.ndarray:
        z = np.clip((figures - self.mean) / self.deviation, -EDGE, EDGE)
        waves = np.cos(z @ self.w + self.b) * np.sqrt(2 / (FEATURES - 1))
        return np.column_stack([waves, np.ones(len(waves))])


def _figures(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(name).to_numpy(zero_copy_only=False) for name in STATISTICS])


_PARTIAL = "fold int, part long, n long, ones long, sums binary"
_TRIANGLE = np.triu_indices(FEATURES)


def _summer(kernel: Kernel):
    """Each task's sums of feature products and of features with label 1, one row a fold."""

    @tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right = np.zeros((FOLDS, FEATURES, FEATURES)), np.zeros((FOLDS, FEATURES))
        n, ones = np.zeros(FOLDS, np.int64), np.zeros(FOLDS, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                phi, fold = kernel(_figures(batch)), batch.column("fold").to_numpy()
                label = batch.column("label").to_numpy().astype(float)
                for f in range(FOLDS):
                    mine = fold == f
                    gram[f] += phi[mine].T @ phi[mine]
                    right[f] += phi[mine].T @ label[mine]
                    n[f] += mine.sum()
                    ones[f] += int(label[mine].sum())
        sums = [np.concatenate([gram[f][_TRIANGLE], right[f]]).tobytes() for f in range(FOLDS)]
        part = np.full(FOLDS, TaskContext.get().partitionId(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(FOLDS), pa.int32()), pa.array(part), pa.array(n), pa.array(ones), pa.array(sums, pa.binary())], ["fold", "part", "n", "ones", "sums"])

    return add


def _added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n, ones = np.zeros(_SUMS), 0, 0
    for batch in batches:
        for sums, a, b in zip(batch.column("sums"), batch.column("n").to_pylist(), batch.column("ones").to_pylist(), strict=True):
            total += np.frombuffer(sums.as_buffer(), np.float64)
            n, ones = n + a, ones + b
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), pa.array([n]), pa.array([ones]), pa.array([total.tobytes()], pa.binary())], ["fold", "part", "n", "ones", "sums"])


def normal_equations(labelled: DataFrame, rows: int, kernel: Kernel) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(matrices, right sides, rows, rows with label 1), by fold."""
    parts = max(1, -(-rows // ROWS))
    sums = labelled.coalesce(parts).mapInArrow(_summer(kernel), _PARTIAL)
    while parts > 1:
        sums = sums.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("fold", "part").applyInArrow(_added, _PARTIAL)
        parts = -(-parts // FAN)
    found = sorted(sums.collect(), key=lambda r: r["fold"])  # FOLDS rows
    matrices = np.zeros((FOLDS, FEATURES, FEATURES))
    flat = np.array([np.frombuffer(r["sums"], np.float64) for r in found])
    for f in range(FOLDS):
        matrices[f][_TRIANGLE] = flat[f, :-FEATURES]
        matrices[f] += np.triu(matrices[f], 1).T
    return matrices, flat[:, -FEATURES:], np.array([r["n"] for r in found]), np.array([r["ones"] for r in found])


def ridge(matrix: np.ndarray, right: np.ndarray, n: int, strength: float = RIDGE) -> np.ndarray:
    """Weights; the last one, of the constant, is not shrunk."""
    penalty = np.full(FEATURES, strength * max(1, n) / FEATURES + 1e-3)
    penalty[-1] = 1e-9
    return np.linalg.solve(matrix + np.diag(penalty), right)


def rising(x: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (middle score, share of label 1) of each step, both rising. x rises; n rows at each, `ones` of label 1."""
    steps: list[list[float]] = []
    for at, many, hits in zip(x.tolist(), n.tolist(), ones.tolist(), strict=True):
        steps.append([at * many, many, hits])
        while len(steps) > 1 and steps[-2][2] * steps[-1][1] >= steps[-1][2] * steps[-2][1]:
            last = steps.pop()
            steps[-1] = [a + b for a, b in zip(steps[-1], last, strict=True)]
    return np.array([s[0] / s[1] for s in steps]), np.array([(s[2]) / (s[1]) for s in steps])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    training = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    training = training.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label"))
    schema = "doc_id long, " + ", ".join(f"{name} double" for name in STATISTICS)
    table = Written(whole_texts(docs).mapInArrow(_look, schema), "quality-figures").df
    found = table.select(*(F.avg(c) for c in STATISTICS), *(F.stddev_pop(c) for c in STATISTICS)).first()
    figures = np.array([0.0 if v is None else v for v in found])
    kernel = Kernel(figures[:_K], figures[_K:])

    joined = table.join(training, "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int"))
    labelled = Written(joined, "quality-labelled")
    rows = labelled.df.count()
    matrices, rights, n, ones = normal_equations(labelled.df, rows, kernel)
    base = float((ones.sum() + 1) / (n.sum() + 2))
    weights, steps = np.zeros(FEATURES), (np.zeros(1), np.array([base]))
    if 0 < ones.sum() < n.sum():
        weights = ridge(matrices.sum(0), rights.sum(0), int(n.sum()))
        others = np.stack([ridge(matrices.sum(0) - matrices[f], rights.sum(0) - rights[f], int(n.sum() - n[f])) for f in range(FOLDS)])

        @tidy
        def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, ones, total = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64), np.zeros(BINS)
            for batch in batches:
                raw = (kernel(_figures(batch)) * others[batch.column("fold").to_numpy()]).sum(1)
                at = np.clip(((raw - _LOW) / (_HIGH - _LOW) * BINS).astype(np.int64), 0, BINS - 1)
                n += np.bincount(at, minlength=BINS)
                ones += np.bincount(at, batch.column("label").to_numpy(), BINS).astype(np.int64)
                total += np.bincount(at, raw, BINS)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(ones[some]), pa.array(total[some])], ["bin", "n", "ones", "total"])

        bins = labelled.df.mapInArrow(binned, "bin long, n long, ones long, total double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"), F.sum("total").alias("total"))
        bins = bins.toPandas().sort_values("bin")  # BINS rows at most
        steps = rising((bins["total"] / bins["n"]).to_numpy(), bins["n"].to_numpy(), bins["ones"].to_numpy())
    labelled.drop()

    @tidy
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = kernel(_figures(batch)) @ weights if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.clip(np.interp(raw, *steps), 0, 1))], ["doc_id", "score"])

    scored = table.mapInArrow(apply, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that are not predicted to be of low quality."""
    bad = score(docs, labels).where("predicted = 0").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)
