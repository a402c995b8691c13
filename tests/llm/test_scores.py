"""Whitening, quality and divergence of sources against numpy, held-out labels and plain Python."""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from oracle import TESTDATA, differences
from pyspark.sql import functions as F

from caseframe.llm import divergence, quality, whitening
from caseframe.llm.queries import ORACLE_SQL, QUERIES

SF = f"{TESTDATA}/sf0.001"
VECTORS = "vec_id long, embedding array<float>"
DOCS = "doc_id long, text string, lang string, source string"
LABELS = "doc_id long, quality int"


# ---------------------------------------------------------------------------------------------------------------
# op11


def whitened(rows: list[tuple[int, list[float]]], k: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(deviation, whitened, explained) by numpy and Python's integers."""
    x = [[int(np.floor(1024 * np.float64(np.float32(c)))) + 100_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = np.array([sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x])
    y = np.array([[a - s / n for a, s in zip(v, sums, strict=True)] for v in x])
    cov = y.T @ y / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    return deviation, y @ u[:, :k] / np.sqrt(e[:k]), e[:k] / np.trace(cov)


def same_up_to_sign(found: np.ndarray, want: np.ndarray, within: float = 1e-7) -> bool:
    return all(min(np.abs(found[:, c] - want[:, c]).max(), np.abs(found[:, c] + want[:, c]).max()) < within for c in range(want.shape[1]))


def test_whitening_is_what_numpy_finds(spark):
    draw = np.random.default_rng(5)
    rows = [(i, (draw.normal(size=11) * np.arange(1, 12) + 3).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i + 300, rows[i][1]) for i in range(40)]  # repeated vectors count each
    found = whitening.whiten(spark.createDataFrame(rows, VECTORS)).toPandas().sort_values(["component", "vec_id"])
    deviation, want, explained = whitened(rows)
    assert len(found) == 340 * 8 and set(found["n"]) == {340}
    assert found[found["component"] == 3]["deviation"].tolist() == deviation.tolist()
    assert same_up_to_sign(found["whitened"].to_numpy().reshape(8, 340).T, want)
    assert np.allclose(found.groupby("component")["explained"].first(), explained, rtol=1e-9)
    assert found["identity_error"].nunique() == 1 and 0 <= found["identity_error"].iloc[0] < 1e-9


def test_wide_vectors_take_several_aggregations(spark, monkeypatch):
    draw = np.random.default_rng(6)
    rows = [(i, draw.normal(size=20).astype(np.float32).tolist()) for i in range(100)]
    frame = spark.createDataFrame(rows, VECTORS)
    once = whitening.fit(frame)
    monkeypatch.setattr(whitening, "PAIRS", 17)
    assert np.allclose(whitening.fit(frame).covariance, once.covariance, rtol=1e-12)


def test_awkward_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 2.0, 5.0]), (2, [2.0, 0.5, 5.0]), (2, [2.0, 0.5, 5.0]), (None, [0.0, -1.0, 5.0]), (4, None), (5, [1.0, None, 2.0]), (6, [nan, 1.0, 1.0]), (7, [1.0, inf, 1.0]), (8, []), (9, [1.0]), (10, [1e30, 1.0, 1.0])]
    frame = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], VECTORS + ", x0 string, n int")
    found = whitening.whiten(frame).toPandas()
    assert Counter(found["vec_id"].fillna(-1).astype(int)) == {1: 3, 2: 6, -1: 3} and set(found["n"]) == {4}
    # The third dimension is constant: no variance, nothing to whiten.
    assert found[found["component"] == 3]["whitened"].isna().all() and (found[found["component"] == 3]["explained"] == 0).all()
    deviation, want, _ = whitened([r for r in rows[:4]], 2)
    first = found[found["component"] == 1].sort_values("deviation")
    assert first["deviation"].tolist() == sorted(deviation.tolist()) and found["identity_error"].max() < 1e-9
    assert sorted(first["whitened"].abs().round(6)) == sorted(np.abs(want[:, 0]).round(6))


def test_deviation_that_is_no_long_is_null(spark):
    found = whitening.whiten(spark.createDataFrame([(1, [1e12]), (2, [-1e12])], VECTORS)).collect()
    assert [r["deviation"] for r in found] == [None, None] and all(abs(abs(r["whitened"]) - 1) < 1e-9 for r in found)


def test_one_vector_and_none(spark):
    only = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], VECTORS)).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in only] == [(1, 0, None, 0, None), (2, 0, None, 0, None)]
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(spark.createDataFrame([(1, None)], VECTORS)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_whitening_query_over_the_table(spark):
    found = QUERIES["op11_embedding_whitening"](spark, SF).toPandas().sort_values(["component", "vec_id"])
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    deviation, want, explained = whitened(list(zip(table["vec_id"], table["embedding"], strict=True)))
    n = len(table)
    assert found[found["component"] == 1]["deviation"].tolist() == deviation.tolist()
    assert same_up_to_sign(found["whitened"].to_numpy().reshape(8, n).T, want)
    assert np.allclose(found.groupby("component")["explained"].first(), explained, rtol=1e-9) and found["identity_error"].max() < 1e-9


# ---------------------------------------------------------------------------------------------------------------
# op12


def test_statistics_of_known_texts():
    names = quality.STATISTICS
    texts = [b"", b"Ab cd. Ab cd.\nAb cd. Ab cd.", "Größe! 12##".encode(), b"\n\n"]
    got = pd.DataFrame(quality.statistics(texts), columns=names)
    assert got["bytes"].round(6).tolist() == np.log1p([0, 27, 13, 2]).round(6).tolist()
    assert got["words"].round(6).tolist() == np.log1p([0, 8, 2, 0]).round(6).tolist()
    assert got["lines"].round(6).tolist() == np.log1p([1, 2, 1, 3]).round(6).tolist()
    assert got["distinct_words"].round(6).tolist() == [0, 0.25, 1, 0] and got["most_frequent"].round(6).tolist() == [0, 0.5, 0.5, 0]
    assert got["distinct_lines"].round(6).tolist() == [1, 0.5, 1, round(1 / 3, 6)]
    assert got["upper"].round(6).tolist() == [0, round(4 / 27, 6), round(1 / 13, 6), 0] and got["symbols"].round(6)[2] == round(2 / 13, 6)
    assert got["doubled_words"].tolist() == [0, 0, 0, 0] and quality.statistics([b"a a b b"])[0][names.index("doubled_words")] == 0.5
    assert np.isfinite(got.to_numpy()).all()
    # A text's figures don't depend on its neighbours.
    assert np.allclose(quality.statistics(texts[1:2])[0], got.iloc[1]) and np.allclose(quality.statistics(texts[2:3])[0], got.iloc[2])


def test_pool_adjacent_violators_is_the_best_rising_fit():
    draw = np.random.default_rng(3)
    n = draw.integers(1, 9, 60)
    ones = draw.binomial(n, np.linspace(0.1, 0.9, 60))
    x, y = quality.rising(np.arange(60.0), n, ones)
    assert (np.diff(x) > 0).all() and (np.diff(y) > 0).all()
    # Max-min formula of isotonic regression at each bin.
    cn, co = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(ones)])
    best = [max(min((co[b] - co[a]) / (cn[b] - cn[a]) for b in range(i + 1, 61)) for a in range(i + 1)) for i in range(60)]
    assert np.allclose(sorted(set(np.round(best, 9))), np.round(y, 9))


def test_normal_equations_count_every_row(spark, monkeypatch):
    monkeypatch.setattr(quality, "ROWS", 7)
    monkeypatch.setattr(quality, "FAN", 2)
    draw = np.random.default_rng(9)
    figures = draw.normal(size=(50, len(quality.STATISTICS)))
    fold, label = np.arange(50) % quality.FOLDS, draw.integers(0, 2, 50)
    frame = pd.DataFrame(figures, columns=quality.STATISTICS)
    frame["fold"], frame["label"] = fold.astype(np.int32), label.astype(np.int32)
    kernel = quality.Kernel(np.zeros(figures.shape[1]), np.ones(figures.shape[1]))
    labelled = spark.createDataFrame(frame).repartition(8).withColumn("fold", F.col("fold").cast("int"))
    gram, right, n, ones = quality.normal_equations(labelled, 50, kernel)
    phi = kernel(figures)
    for f in range(quality.FOLDS):
        assert np.allclose(gram[f], phi[fold == f].T @ phi[fold == f]) and np.allclose(right[f], phi[fold == f].T @ label[fold == f])
    assert n.sum() == 50 and ones.sum() == label.sum()


def held(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.mark.skipif(not os.path.isdir(f"{TESTDATA}/sf0.01"), reason="the driver's tables are not here")
def test_quality_of_held_out_rows(spark):
    found = QUERIES["op12_fourier_quality"](spark, f"{TESTDATA}/sf0.01").toPandas()
    docs = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet").select("doc_id").toPandas()
    assert sorted(found["doc_id"]) == sorted(docs["doc_id"]) and (found["held_out"] == found["doc_id"].map(held)).all()
    assert found["score"].between(0, 1).all() and (found["predicted"] == (found["score"] >= 0.3)).all()
    rows = found[found["held_out"]].merge(spark.read.parquet(f"{TESTDATA}/sf0.01/labels.parquet").toPandas(), on="doc_id")
    good, bad = rows[rows["quality"] == 1]["score"], rows[rows["quality"] == 0]["score"]
    wins = (good.to_numpy()[:, None] > bad.to_numpy()).mean() + 0.5 * (good.to_numpy()[:, None] == bad.to_numpy()).mean()
    assert wins > 0.97 and (rows["predicted"] == rows["quality"]).mean() > 0.95


def test_quality_of_awkward_rows(spark):
    good = [(i, f"the river ran by a quiet town number {i} and nobody minded.", "en", "s") for i in range(0, 80, 2)]
    bad = [(i, "!!$$ ## %% " * (i % 7 + 3), "en", "s") for i in range(1, 80, 2)]
    odd = [(100, None, None, None), (101, "", "en", "s"), (102, "word " * 200_000, "en", "s"), (103, "same", "en", "s"), (103, "same", "en", "s"), (None, "x", "en", "s")]
    docs = spark.createDataFrame([(*r, 1.0, 2) for r in good + bad + odd], DOCS + ", score double, label int")
    labels = spark.createDataFrame([(r[0], int(r in good)) for r in good + bad] + [(1, None), (2, 7), (None, 1)], LABELS)
    found = quality.score(docs, labels).toPandas()
    assert Counter(found["doc_id"]) == Counter(r[0] for r in good + bad + odd if r[0] is not None) and found["score"].between(0, 1).all()
    out = found[found["held_out"] & (found["doc_id"] < 80)]
    assert len(out) and (out["predicted"] == (out["doc_id"] % 2 == 0)).all()
    assert found[found["doc_id"] == 100]["score"].tolist() == found[found["doc_id"] == 101]["score"].tolist()
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id IS NULL").count() == 1


def test_quality_without_labels_and_without_documents(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s"), (2, None, "en", "s")], DOCS)
    assert [r["score"] for r in quality.score(docs, spark.createDataFrame([], LABELS)).collect()] == [0.5, 0.5]
    one = quality.score(docs, spark.createDataFrame([(1, 1)], LABELS)).collect()
    assert [round(r["score"], 6) for r in one] == [round(2 / 3, 6) if not held(1) else 0.5] * 2
    assert quality.score(docs.limit(0), spark.createDataFrame([(1, 1)], LABELS)).count() == 0


# ---------------------------------------------------------------------------------------------------------------
# op13


def audited(rows: list[tuple], documents: int, top: int) -> list[tuple]:
    """The contract in plain Python."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= documents]
        p = {s: dict.fromkeys(kept, 0) for g, s in groups if g == lang}
        for s in p:
            total = sum(counts[lang, s][t] for t in kept)
            p[s] = {t: 1 + 10**9 * (counts[lang, s][t] + 2) // (total + 2 * len(kept)) for t in kept}
        all_ = Counter()
        for s in p:
            all_.update({t: counts[lang, s][t] for t in kept})
        q = {t: 1 + 10**9 * (all_[t] + 2) // (sum(all_.values()) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        mine = p[source]
        pairs = sorted((-sum(f(mine[t], p[s][t]) for t in kept), s.encode()) for s in p if s != source)
        terms = sorted((-f(mine[t], q[t]), t.encode()) for t in kept if counts[lang, source][t] > 0 and mine[t] > q[t])[:top]
        out += [(lang, source, part, item.decode(), -v, i + 1) for part, found in (("pair", pairs), ("term", terms)) for i, (v, item) in enumerate(found)]
    return sorted(out)


def corpus(n: int, sources: int, seed: int) -> list[tuple]:
    draw = np.random.default_rng(seed)
    words = ["Alpha", "beta", "Größe", "été", "x", "naïve", "γδ", "end", "ÀB", "zz9q", "o'er", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120))]
    return [(i, " ".join(draw.choice(words, int(draw.integers(0, 40)))), ["en", "de", None][i % 3], [f"s{j}" for j in range(sources)][int(draw.integers(0, sources)) if i % 5 else 0]) for i in range(n)]


@pytest.mark.parametrize(("block", "width"), [(8, 8192), (2, 16), (1, 5), (3, 50)])
def test_divergence_is_exact_for_any_blocks_and_chunks(spark, block, width):
    rows = corpus(250, 7, 4)
    found = divergence.audit(spark.createDataFrame(rows, DOCS), documents=5, top=4, block=block, width=width)
    assert sorted(map(tuple, found.collect())) == audited(rows, 5, 4)


def test_divergence_of_awkward_rows(spark):
    rows = [(1, None, None, None), (1, "", "en", ""), (None, "a B c" * 3, "en", "s"), (2, "a b c", "en", "t"), (2, "a b c", "en", "t"), (3, "Z " * 50_000 + "é" * 70_000, "en", "u"), (4, "1 2 3 ...", "en", "none"), (5, "x", "de", "only"), (6, "q", "fr", "a"), (7, "r", "fr", "b")]
    docs = spark.createDataFrame([(*r, 1, "v") for r in rows], DOCS + ", n int, term string")
    found = sorted(map(tuple, divergence.audit(docs, documents=2).collect()))
    assert found == audited(rows, 2, 10)
    assert [r[4] for r in found if r[0] == "fr"] == [0, 0]  # no kept term
    assert divergence.audit(docs.limit(0)).count() == 0


def test_divergence_passes_counts_on_in_parts(spark, monkeypatch):
    rows = corpus(60, 3, 8)
    monkeypatch.setattr(divergence, "HELD", 20)
    monkeypatch.setattr(divergence, "PIECE", 16)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[c] or "" for r in rows]) for c in (2, 3, 1)], ["lang", "source", "text"])
    parts = [p.to_pandas() for p in divergence._count(iter([batch]))]
    assert len(parts) > 3
    whole = pd.concat(parts).groupby(["lang", "source", "term"])[["n", "docs"]].sum()
    want, docs = Counter(), Counter()
    for _, text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        want.update((lang or "", source, t) for t in terms)
        docs.update({(lang or "", source, t) for t in terms})
    assert whole["n"].to_dict() == dict(want) and whole["docs"].to_dict() == dict(docs)


def test_frequency_is_exact_beyond_doubles():
    draw = np.random.default_rng(2)
    for total, v in ((0, 1), (5, 3), (10**15, 10**6), (9 * 10**14, 7)):
        counts = np.unique(np.concatenate([[0, total], draw.integers(0, total + 1, 50)]))
        assert divergence.frequency(counts, total, v).tolist() == [1 + 10**9 * (c + 2) // (total + 2 * v) for c in counts.tolist()]


def test_units_survive_packing():
    draw = np.random.default_rng(1)
    row, term, n = draw.integers(0, 9, 400), draw.permutation(400), draw.integers(1, 10**12, 400)
    got = divergence.unpack(divergence.pack(row, term, n))
    assert sorted(zip(*(c.tolist() for c in got), strict=True)) == sorted(zip(row.tolist(), term.tolist(), n.tolist(), strict=True))
    assert [len(c) for c in divergence.unpack(None)] == [0, 0, 0]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_divergence_query_gives_the_rows_of_its_sql(spark):
    assert differences(QUERIES["op13_source_divergence"](spark, SF), SF, ORACLE_SQL["op13_source_divergence"]) == []
