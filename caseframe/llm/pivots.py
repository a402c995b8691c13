"""Embedding near-duplicates with a pivot-permutation index.

Equal vectors are one entry with a number of copies. Pivots, PER_ROOT times the root of the number of entries (so that lists grow
with the root too), are the first entries by a hash; that sample only chooses reference points, and every entry is
indexed.

Dense groups are compared exactly. Leaders are pivots, none of which is within LEAD of an earlier one; an entry within LEAD of
its nearest leader is dense and lives in the leader's cell. Into a cell come, as visitors, all entries that its radius and (if
they live in a later cell) the plane between the two leaders do not rule out; a resident meets all residents and visitors, so
that no pair with a dense entry is missed.

All other entries are described by their NEAREST pivots in order, and stand in the list of each of them. Two of these are
candidates in a list when their descriptions share at least SHARED pivots, and a pair that meets in several lists counts in that
of its smallest shared pivot. Pairs are compared by cosine in double precision. Lists and cells longer than BLOCK are cut into
blocks by hash, and every two blocks meet in a task of their own.

A task returns one row for each entry that has links: how many vectors it is linked to there, and the smallest entry that the
task's links reach from it. Components come from joining those.

Null or empty vectors, zero vectors and vectors with null or non-finite components link with nothing; finite components of any
size do (vectors are scaled by their largest before squaring). Vectors of other lengths never link. Ties between pivots go to the smaller pivot number. Rows that repeat a vec_id count as vectors of their own,
returned once for each row. An empty table gives no rows; columns but vec_id and embedding are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseframe.llm.common import Written
from caseframe.llm.graph import components

COSINE = 0.95
PER_ROOT, LEAST_PIVOTS = 2.0, 32
NEAREST, SHARED = 10, 2
LEAD = 0.8
BLOCK = 1024
#: Pivots go to every task: fewer of them where they would take more bytes than this (lists get longer, and are cut into blocks).
PIVOT_BYTES = 128_000_000
#: Cosines (entries x pivots) that a task holds at once.
AT_ONCE = 2_000_000


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, digest (null: links with nothing) and unit vector as bytes of doubles."""
    for batch in batches:
        digests, units = [], []
        for v in batch.column("embedding").to_pylist():
            x = None if not v or None in v else np.array(v, np.float64)
            top = 0.0 if x is None or not np.isfinite(x).all() else float(np.abs(x).max())
            if top > 0:
                x = x + 0.0  # one zero
                digests.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                x = x / top  # squares neither overflow nor vanish
                units.append((x / np.linalg.norm(x)).tobytes())
            else:
                digests.append(None)
                units.append(None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(digests, pa.binary()), pa.array(units, pa.binary())], ["vec_id", "digest", "unit"])


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, size)


def leaders_of(pivots: np.ndarray) -> np.ndarray:
    """Numbers of the pivots that are not within LEAD of an earlier leader."""
    out = np.empty(0, np.int64)
    for at in range(0, len(pivots), BLOCK):
        block = pivots[at : at + BLOCK]
        led = np.zeros(len(block), bool)
        for begin in range(0, len(out), BLOCK):
            led |= (block @ pivots[out[begin : begin + BLOCK]].T >= LEAD).any(1)
        near, own = block @ block.T >= LEAD, []
        for i in range(len(block)):
            if not led[i]:
                own.append(at + i)
                led |= near[i]
        out = np.concatenate([out, np.array(own, np.int64)])
    return out


def _by_size(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(vector length, rows of that length, their unit vectors), AT_ONCE / pivots rows at a time."""
    for batch in batches:
        sizes = pa.compute.divide(pa.compute.binary_length(batch.column("unit")), 8).to_numpy(zero_copy_only=False)
        for size in np.unique(sizes).tolist():
            rows = batch.filter(pa.array(sizes == size))
            step = max(1, AT_ONCE // len(pivots[size]))
            for at in range(0, rows.num_rows, step):
                part = rows.slice(at, step)
                yield size, part, _matrix(part.column("unit"), size)


def _cells(units: np.ndarray, leaders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the nearest leader, or -1 for entries that are not dense; cosines with all leaders)."""
    cosines = units @ leaders.T
    nearest = np.round(cosines, 12).argmax(1)
    return np.where(cosines[np.arange(len(units)), nearest] >= LEAD, nearest, -1), cosines


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def _radii(pivots: dict[int, np.ndarray], leaders: dict[int, np.ndarray]):
    """The widest angle of a resident from the leader of each cell, of the rows of a task."""

    def radii(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widest = {size: np.full(len(own), -1.0) for size, own in leaders.items()}
        for size, _, units in _by_size(batches, pivots):
            cell, cosines = _cells(units, pivots[size][leaders[size]])
            dense = np.flatnonzero(cell >= 0)
            np.maximum.at(widest[size], cell[dense], _angles(cosines[dense, cell[dense]]))
        for size, w in widest.items():
            some = np.flatnonzero(w >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), size, np.int32)), pa.array(some.astype(np.int32)), pa.array(w[some])], ["size", "cell", "radius"])

    return radii


def _lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """Lists of `values`, ordered by `rows`, for rows 0 to n - 1."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), pa.array(values.astype(np.int32)))


def _describe(pivots: dict[int, np.ndarray], leaders: dict[int, np.ndarray], radii: dict[int, np.ndarray], nearest: int, cosine: float):
    """near: the nearest pivots; home: the cell (-1 - place of its leader) or 0; places: lists (pivots) and cells to stand in."""
    reach, slack = float(_angles(np.array(cosine))), 1e-6
    sine = np.sin(min(reach, np.pi / 2))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, part, units in _by_size(batches, pivots):
            own, n = pivots[size], len(units)
            order = np.argsort(-np.round(units @ own.T, 12), axis=1, kind="stable")[:, :nearest]
            width = order.shape[1]
            lead = own[leaders[size]]
            cell, cosines = _cells(units, lead)
            dense = np.flatnonzero(cell >= 0)
            comes = _angles(cosines) <= radii[size] + reach + slack
            apart = np.sqrt(np.maximum(0, 2 - 2 * (lead[cell[dense]] @ lead.T)))
            comes[dense] &= cosines[dense, cell[dense]][:, None] - cosines[dense] <= sine * apart + slack
            comes[dense] &= np.arange(len(lead)) < cell[dense][:, None]
            comes[dense, cell[dense]] = True
            row, place = np.nonzero(comes)
            loose = np.flatnonzero(cell < 0)
            rows, places = np.concatenate([row, np.repeat(loose, width)]), np.concatenate([-1 - place, order[loose].ravel()])
            by_row = np.argsort(rows, kind="stable")
            near = _lists(np.repeat(np.arange(n), width), order.ravel(), n)
            home = pa.array(np.where(cell >= 0, -1 - cell, 0).astype(np.int32))
            columns = [part.column("entry"), part.column("copies"), part.column("unit"), pa.array(np.full(n, size, np.int32)), near, home, _lists(rows[by_row], places[by_row], n)]
            yield pa.RecordBatch.from_arrays(columns, ["entry", "copies", "unit", "size", "near", "home", "places"])

    return describe


def _meet(cosine: float, shared: int):
    """Links between the blocks of one list or cell: (entry, n, least)."""

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        size, pivot, left, right = (k.as_py() for k in key)
        block = rows.column("block").to_numpy()
        entry, copies = rows.column("entry").to_numpy(), rows.column("copies").to_numpy()
        units = _matrix(rows.column("unit"), size)
        near = np.array(rows.column("near").to_pylist(), np.int64)
        cell = pivot < 0
        resident = rows.column("home").to_numpy() == pivot
        if not cell:
            own, column = np.unique(near, return_inverse=True)  # pivots of these rows only: two blocks' at most
            holds = np.zeros((len(entry), len(own)), np.float32)
            np.put_along_axis(holds, column.reshape(near.shape), 1, 1)
        a = np.flatnonzero(block == left)
        b = np.flatnonzero(block == right)
        found = []
        for at in range(0, len(a), BLOCK):
            some = a[at : at + BLOCK]
            mask = resident[some][:, None] | resident[b] if cell else holds[some] @ holds[b].T >= min(shared, near.shape[1])
            mask &= units[some] @ units[b].T >= cosine
            i, j = np.nonzero(mask)
            found.append(np.stack([some[i], b[j]], 1))
        i, j = np.concatenate(found).T if found else (np.empty(0, np.int64),) * 2
        keep = entry[i] < entry[j] if left == right else i != j
        i, j = i[keep], j[keep]
        for begin in range(0, 0 if cell else len(i), 65536):  # the list of the smallest shared pivot counts the pair
            x, y = near[i[begin : begin + 65536]], near[j[begin : begin + 65536]]
            common = (x[:, :, None] == y[:, None, :]).any(2)
            first = np.where(common, x, np.iinfo(np.int64).max).min(1)
            mine = first == pivot
            i[begin : begin + 65536][~mine] = -1
        j, i = j[i >= 0], i[i >= 0]
        n = np.bincount(i, copies[j], len(entry)) + np.bincount(j, copies[i], len(entry))
        reach = entry.copy()
        while len(i):
            low = np.minimum(reach[i], reach[j])
            before = reach.copy()
            np.minimum.at(reach, i, low)
            np.minimum.at(reach, j, low)
            if (reach == before).all():
                break
        some = np.flatnonzero(n)
        return pa.table([pa.array(entry[some]), pa.array(n[some].astype(np.int64)), pa.array(reach[some])], ["entry", "n", "least"])

    return meet


def link(vectors: DataFrame, cosine: float = COSINE, nearest: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    known = Written(rows.mapInArrow(_entries, "vec_id long, digest binary, unit binary"), "vectors").df
    real = known.where("digest IS NOT NULL")
    entries = Written(real.groupBy("digest").agg(F.min("vec_id").alias("entry"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit")), "entries").df

    sizes = {r["size"]: r["n"] for r in entries.groupBy((F.length("unit") / 8).cast("int").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each vector length
    pivots = {}
    for size, n in sizes.items():
        wanted = max(LEAST_PIVOTS, min(int(PER_ROOT * n**0.5), PIVOT_BYTES // (8 * size)))
        chosen = entries.where(F.length("unit") == 8 * size).orderBy(F.xxhash64("digest"), "digest").limit(wanted).select("unit").collect()
        pivots[size] = np.frombuffer(b"".join(bytes(r["unit"]) for r in chosen), np.float64).reshape(-1, size)

    leaders = {size: leaders_of(own) for size, own in pivots.items()}
    radii = {size: np.full(len(own), -np.inf) for size, own in leaders.items()}
    widest = entries.select("unit").mapInArrow(_radii(pivots, leaders), "size int, cell int, radius double").groupBy("size", "cell").agg(F.max("radius").alias("radius"))
    for r in widest.collect():  # as many rows as leaders
        radii[r["size"]][r["cell"]] = r["radius"]

    described = entries.select("entry", "copies", "unit").mapInArrow(
        _describe(pivots, leaders, radii, nearest, cosine), "entry long, copies long, unit binary, size int, near array<int>, home int, places array<int>"
    )
    described = Written(described, "described").df
    placed = described.withColumn("pivot", F.explode("places")).drop("places")
    lengths = described.select("size", F.explode("places").alias("pivot")).groupBy("size", "pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = placed.join(F.broadcast(lengths), ["size", "pivot"])  # as many rows as pivots and leaders
    placed = placed.withColumn("block", F.pmod(F.xxhash64("entry"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("entry", "copies", "unit", "size", "near", "home", "pivot", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    met = placed.groupBy("size", "pivot", "left", "right").applyInArrow(_meet(cosine, shared), "entry long, n long, least long")
    met = Written(met, "met").df

    reached = components(met.select(F.col("entry").alias("a"), F.col("least").alias("b"))).df
    linked = met.groupBy("entry").agg(F.sum("n").alias("n"))
    by_entry = entries.select("digest", "entry", "copies").join(linked, "entry", "left").join(reached.select(F.col("v").alias("entry"), "component"), "entry", "left")
    by_entry = by_entry.select("digest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "entry").alias("component_id"))
    alone = known.where("digest IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = real.select("vec_id", "digest").join(by_entry, "digest").select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
c AS (SELECT a AS v, b AS r FROM p UNION SELECT c.v, p.b FROM c JOIN p ON c.r = p.a),
m AS (SELECT v, min(r) AS least FROM c GROUP BY v),
d AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(least(vec_id, least), vec_id) AS component_id, vec_id = coalesce(least(vec_id, least), vec_id) AS kept
FROM embeddings LEFT JOIN d ON vec_id = a LEFT JOIN m ON vec_id = v
"""
