"""Near duplicates by the document counts of all shingles, against the words themselves."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from caseframe.llm import mail, near_dup
from caseframe.llm.common import one_text_each
from caseframe.llm.queries import op4_weighted_minhash_near_dup


def shingles(text: str | None) -> list[tuple[str, ...]]:
    words = re.findall(r"[0-9a-z]+", (text or "").lower())
    return [tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))] if words else []


def drawn(seed: int, n: int) -> str:
    return " ".join(f"w{k}" for k in np.random.default_rng(seed).integers(0, 10**6, n))


def classes(rows: list[tuple[int, str | None]], least: float = 0.8) -> dict[int, int]:
    """All pairs, without fingerprints."""
    counts = [Counter(shingles(t)) for _, t in rows]
    held = Counter(s for c in counts for s in c)
    idf = {s: (1 + np.log((1 + len(rows)) / (1 + n))) / (1 + np.log((1 + len(rows)) / 2)) for s, n in held.items()}
    vectors = [{s: (1 + np.log(n)) * idf[s] for s, n in c.items()} for c in counts]
    of = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            low = sum(min(w, vectors[j][s]) for s, w in vectors[i].items() if s in vectors[j])
            if low and low / (sum(vectors[i].values()) + sum(vectors[j].values()) - low) >= least - 1e-9:
                a, b = sorted((of[i], of[j]))
                of = [a if x == b else x for x in of]
    return {rows[i][0]: rows[of[i]][0] for i in range(len(rows))}


def chain() -> list[tuple[int, str | None]]:
    words = drawn(50, 120).split()
    rows: list[tuple[int, str | None]] = [(i, " ".join(words[:k] + words[k + 1 :])) for i, k in enumerate(range(5, 110, 7))]
    rows += [(100 + i, " ".join(f"new{j}" if j < 2 * i else w for j, w in enumerate(words))) for i in range(12)]
    return [*rows, (200, None), (201, "one two"), (202, "One, two"), (203, "x " * 40 + "y z"), (204, "x " * 41 + "y z")]


@pytest.mark.parametrize(("block", "unit"), [(near_dup.BLOCK, mail.UNIT), (2, 200)])
def test_classes_are_those_of_all_pairs(spark, block, unit):
    rows = chain()
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(table, block=block, prune=False, rising=True, unit=unit).collect()}
    assert got == classes(rows)


@pytest.mark.parametrize(("parts", "unit"), [(1, mail.UNIT), (5, 100)])
def test_every_shingle_is_counted_over_all_documents(spark, parts, unit):
    rows = chain()
    signed, idf = near_dup._signed_by_counts(one_text_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)), unit)
    held = Counter(s for _, t in rows for s in set(shingles(t)))
    got = {r.doc_id: mail.unplanes(bytes(r.held), "<u4").tolist() for r in signed.select("doc_id", "held").collect()}
    assert idf.total == len(rows) and got == {i: [held[s] for s in shingles(t)] for i, t in rows if shingles(t)}


def test_what_many_documents_share_weighs_less_than_their_own_words(spark, tmp_path):
    """A passage of less than a tenth of the documents, with ten words of each one's own: the query and the pipeline's stage keep all."""
    passage = drawn(1, 100)
    rows = [(i, f"{passage} {drawn(100 + i, 10)}") for i in range(30)] + [(i, drawn(1000 + i, 60)) for i in range(30, 400)] + [(400, drawn(1030, 60))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in op4_weighted_minhash_near_dup(spark, str(tmp_path)).where("NOT kept").collect()} == {400}
    assert near_dup.near_duplicates(table).where("NOT kept").count() == 30
    assert near_dup.keep_one(table, rising=True).count() == 400


def test_samples_of_kept_weights_are_those_computed(monkeypatch):
    texts = near_dup.Shingles([drawn(7, 900).encode(), drawn(8, 900).encode()])
    weight = np.where(np.arange(len(texts.hashes)) % 3 == 0, 0.7, np.where(np.arange(len(texts.hashes)) % 3 == 1, 1.0, 1 + np.log(2)))
    monkeypatch.setattr(near_dup, "_row_of", {1.0: 0})
    kept = near_dup.samples(texts, weight)[1]
    assert len(near_dup._row_of) == 3
    monkeypatch.setattr(near_dup, "_row_of", {1.0: 0})
    monkeypatch.setattr(near_dup, "MANY", 10**6)
    assert (near_dup.samples(texts, weight)[1] == kept).all() and len(near_dup._row_of) == 1


def test_few_keys_are_drawn_and_the_smallest_is_found(monkeypatch):
    """Shingles of many weights, below 1, above, repeated, and texts of one shingle: as if every key were drawn."""
    texts = near_dup.Shingles([t.encode() for t in (drawn(9, 3000), "one two", "x " * 300 + drawn(10, 1500), drawn(11, 40), " ".join([drawn(12, 400)] * 3))])
    _, which = np.unique(texts.hashes, return_inverse=True)
    rng = np.random.default_rng(13)
    for low, high in ((0.05, 1.0), (0.3, 1.6), (1.1, 4.0), (1.0, 1.0)):
        weight = rng.uniform(low, high, len(which))[which]
        monkeypatch.setattr(near_dup, "_row_of", {1.0: 0})
        want = np.empty((5, near_dup.SAMPLES), np.uint64)
        for k, factor in enumerate(near_dup._FACTORS):
            z = texts.hashes * factor
            key = near_dup._drawn(np.log(weight), (z >> np.uint64(48)).astype(np.int64)) ^ (z & near_dup._LOW)
            want[:, k] = np.minimum.reduceat(key, np.searchsorted(texts.of, np.arange(5))) & near_dup._LOW
        drawn_, real = [0], near_dup._drawn
        with monkeypatch.context() as m:
            m.setattr(near_dup, "_drawn", lambda ln, triple: drawn_.append(len(triple)) or real(ln, triple))
            assert (near_dup.samples(texts, weight)[1] == want).all()
        assert sum(drawn_) < 0.02 * near_dup.SAMPLES * len(weight)


def edited_copies() -> list[tuple[int, str | None]]:
    """A text, 40 copies of it with six words changed here and there in each, and other texts."""
    words = drawn(60, 300).split()
    changed = lambda i: set(np.random.default_rng(61 + i).choice(60, 6, replace=False) * 5)
    rows: list[tuple[int, str | None]] = [(0, " ".join(words))]
    rows += [(i, " ".join(f"new{i}" if k in changed(i) else w for k, w in enumerate(words))) for i in range(1, 41)]
    return rows + [(i, drawn(2000 + i, 60)) for i in range(41, 400)]


@pytest.mark.parametrize("block", [near_dup.BLOCK, 2])
def test_edited_copies_in_a_large_group_are_found(spark, tmp_path, block):
    """Six words of 300 cost a copy 30 of 296 shingles: similar by 0.8 but for what its own words weigh beside 40 copies."""
    rows = edited_copies()
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(table, rising=True, edited=True, block=block).collect()}
    assert got == {i: 0 if i <= 40 else i for i, _ in rows}
    if block == near_dup.BLOCK:
        table.write.parquet(f"{tmp_path}/documents.parquet")
        assert op4_weighted_minhash_near_dup(spark, str(tmp_path)).where("class_id = 0").count() == 41
        assert near_dup.keep_one(table, rising=True, edited=True).count() == 360


def test_words_in_common_shingles():
    text = drawn(70, 100).split()
    share = lambda a, b: near_dup.kept_words(" ".join(a).encode(), " ".join(b).encode())
    assert share(text, text) == 1 and share(text, drawn(71, 100).split()) == 0
    assert share(text, [*text[:50], "x", *text[51:]]) == 99 / 101
    assert share(text, [*text, *drawn(72, 25).split()]) == 100 / 125
    assert share(text, [*text[:50], "x", *text[50:53], "y", *text[53:]]) == 97 / 105
    assert share(["a", "b"], ["a", "b", "c"]) == 0 and share([], ["a"]) == 0
