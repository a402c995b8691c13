"""Embedding whitening: generated Spark SQL sums every product of two centred dimensions, LAPACK decomposes the covariance.

All passes over the vectors are plain scans that end in one aggregation or in the result; nothing is shuffled but one row a task, and the
driver holds d x d numbers. Entries become longs x = floor(1024 c) + 100000. With S the exact sum of a dimension, m = S / n
rounded to a long and r = S - n m, a centred entry is (x - m) - r / n: the large part goes exactly, before anything is multiplied.

1. The dimension d: the length that most vectors have (of equally many the longest). Vectors of another length, empty ones, and
   those with a null, non-finite or larger than LARGEST entry (its x is no long that could be centred) are left out.
2. n and the sums S, as decimals.
3. sum(y_i * y_j) for i <= j, PAIRS of them in one aggregation: one aggregation for up to 90 dimensions, more for wider vectors.
4. numpy.linalg.eigh; each component's sign is that of its largest entry.
5. The whitened components' covariance over all rows, by covar_pop, gives identity_error.
6. The rows: deviation in checked longs (null where it is no long), components by generated sums.

Repeated rows count each, rows without vec_id too. A component without variance (constant or repeated dimensions, one vector) has
explained 0 and whitened null, and identity_error leaves it out (null if no component has variance). With fewer than 8 dimensions
there are fewer components. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
#: Largest entry: its x, and the difference of two, stay longs.
LARGEST = 2.0**50
#: Sums of products in one aggregation.
PAIRS = 4_096
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Model(NamedTuple):
    """What the fit list says: exact sums, covariance, eigenvalues by falling size and unit components (one a row)."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    components: np.ndarray

    @property
    def kept(self) -> np.ndarray:
        """Components with variance."""
        return self.values > max(1, len(self.values)) * np.finfo(float).eps * max(self.values[0], 0)


def balanced(terms: list[str], join: Callable[[str, str], str]) -> str:
    """Terms joined two by two: an expression as deep as the logarithm of their number."""
    while len(terms) > 1:
        terms = [join(*terms[i : i + 2]) if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


def _number(x: float) -> str:
    return f"({float(x)!r}D)"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of rows without null, non-finite or too large entries."""
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(f"size(embedding) > 0 AND forall(embedding, c -> coalesce(abs(c) < {_number(LARGEST)}, false))")


def _entries(vectors: DataFrame, d: int) -> DataFrame:
    """vec_id and the longs x0, x1, ... of vectors of d dimensions."""
    return vectors.where(f"size(embedding) = {d}").selectExpr("vec_id", *(f"floor({SCALE}D * embedding[{j}]) + {OFFSET}L AS x{j}" for j in range(d)))


def _middles(n: int, sums: list[int]) -> list[tuple[int, int]]:
    """(m, r) of each dimension: S = n m + r, r at most half of n."""
    middle = [(2 * s + n) // (2 * n) for s in sums]
    return [(m, s - n * m) for m, s in zip(middle, sums, strict=True)]


def _centred(entries: DataFrame, n: int, sums: list[int], *also: str) -> DataFrame:
    return entries.selectExpr("vec_id", *also, *(f"CAST(x{j} - ({m}L) AS DOUBLE) - {_number(r / n)} AS y{j}" for j, (m, r) in enumerate(_middles(n, sums))))


def fit(vectors: DataFrame) -> Model | None:
    """The covariance of all usable vectors and its components, or None without a vector."""
    vectors = usable(vectors)
    found = vectors.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if found is None:
        return None
    d, n = found["d"], found["count"]
    entries = _entries(vectors, d)
    exact = ", ".join(f"sum(CAST(x{j} AS DECIMAL(20, 0)))" for j in range(d))
    sums = [int(s) for s in entries.selectExpr(f"array({exact}) AS sums").first()["sums"]]
    centred = _centred(entries, n, sums)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    covariance = np.empty((d, d))
    for at in range(0, len(pairs), PAIRS):
        block = pairs[at : at + PAIRS]
        products = ", ".join(f"sum(y{i} * y{j})" for i, j in block)
        for (i, j), total in zip(block, centred.selectExpr(f"array({products}) AS totals").first()["totals"], strict=True):
            covariance[i, j] = covariance[j, i] = total / n
    values, components = np.linalg.eigh(covariance)
    values, components = values[::-1], components.T[::-1]
    largest = np.abs(components).argmax(axis=1)
    signs = np.where(components[np.arange(d), largest] < 0, -1.0, 1.0)
    return Model(n, sums, covariance, np.maximum(values, 0), components * signs[:, None])


def _projected(centred: DataFrame, model: Model, k: int, *also: str) -> DataFrame:
    """w1 to wk: whitened components."""
    out = []
    for c in range(k):
        terms = [f"{_number(v)} * y{j}" for j, v in enumerate(model.components[c])]
        total = balanced(terms, lambda a, b: f"({a} + {b})")
        out.append(f"{total} / {_number(np.sqrt(model.values[c]))} AS w{c + 1}" if model.kept[c] else f"CAST(NULL AS DOUBLE) AS w{c + 1}")
    return centred.selectExpr("vec_id", *also, *out)


def identity_error(vectors: DataFrame, model: Model, k: int = COMPONENTS) -> float | None:
    """The largest absolute entry of the whitened components' covariance over all rows, minus the identity."""
    known = [c + 1 for c in range(min(k, len(model.values))) if model.kept[c]]
    if not known:
        return None
    rows = _projected(_centred(_entries(usable(vectors), len(model.sums)), model.n, model.sums), model, max(known))
    pairs = [(a, b) for a in known for b in known if a <= b]
    found = rows.selectExpr(f"array({', '.join(f'covar_pop(w{a}, w{b})' for a, b in pairs)}) AS c").first()["c"]
    return max(abs(v - (a == b)) for v, (a, b) in zip(found, pairs, strict=True))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    model = fit(vectors)
    if model is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    n, k = model.n, min(components, len(model.values))
    error = identity_error(vectors, model, k)
    squares = [f"try_multiply(t{j}, t{j})" for j in range(len(model.sums))]
    exact = [f"try_subtract(try_multiply({n}L, x{j} - ({m}L)), {r}L) AS t{j}" for j, (m, r) in enumerate(_middles(n, model.sums))]
    entries = _entries(usable(vectors), len(model.sums))
    rows = entries.selectExpr("*", *exact).selectExpr("*", f"{balanced(squares, lambda a, b: f'try_add({a}, {b})')} AS deviation")
    rows = _projected(_centred(rows, n, model.sums, "deviation"), model, k, "deviation")
    total = float(np.trace(model.covariance))
    each = ", ".join(f"struct({c + 1} AS component, w{c + 1} AS whitened, {_number(model.values[c] / total if total > 0 and model.kept[c] else 0.0)} AS explained)" for c in range(k))
    rows = rows.selectExpr("vec_id", "deviation", f"inline(array({each}))")
    return rows.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).cast("double").alias("identity_error"))
