"""Awkward rows for every operator and stage: repeated rows, null ids, clashing columns, empty tables, one very long text, hot groups."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import LINE, SHARED, brute_lines, brute_scan, brute_substrings, invented, text_of

import corpus_pipeline
from caseframe.llm import decontamination, lines, near_dup, packing, pii, pivots, sharding, substrings, token_store, toxicity
from caseframe.llm.tokens import Encoder, tokenizer_path

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, bucket string, kept string, spans string, row string, shard int, score double"
COPY = invented(40, 90)
#: A third of the rows are one text; ids repeat with one text and with others; one row has no id.
REPEATED = (
    [(i, COPY) for i in range(20)] + [(3, COPY), (3, COPY), (50, invented(50, 40)), (50, invented(51, 40)), (51, None), (51, None), (52, ""), (None, "no id " + SHARED), (53, SHARED), (54, f"x {SHARED} y")]
    + [(60 + i, f"{LINE}\nown words {i} of this text") for i in range(4)] + [(61, f"{LINE}\nmore")] + [(70 + i, invented(700 + i, 30)) for i in range(25)]
)
KNOWN = [(i, t) for i, t in REPEATED if i is not None]


@pytest.fixture(scope="module", params=[1, 7])
def rows(spark, request):
    made = [(i, t, "en", "s", len(t or ""), "b", "k", "z", "r", 1, 0.5) for i, t in REPEATED]
    return spark.createDataFrame(made, COLUMNS).repartition(request.param)


@pytest.fixture(scope="module")
def field():
    return pii.train(pii.labelled_rows(60), steps=10)


def counted(found):
    return Counter(found)


def test_pii_looks_at_rows_one_by_one(rows, field):
    assert counted(r.doc_id for r in pii.find(rows, field).collect()) == counted(i for i, _ in KNOWN)
    cut = pii.redact(rows, field)
    assert cut.columns == rows.columns and cut.count() == len(REPEATED) and cut.where("text IS NULL").count() == 2


def test_store_keeps_every_row(spark, rows, tmp_path):
    token_store.write_store(rows, f"{tmp_path}/s")
    encoder, end = Encoder.of(tokenizer_path()), np.array([1], "<u4").tobytes()
    found = token_store.verify_store(spark, f"{tmp_path}/s").collect()
    want = counted((i, zlib.crc32(encoder.whole([text_of(t).encode()])[0] + end)) for i, t in KNOWN)
    assert counted((r.doc_id, r.ids_crc32) for r in found) == want and all(r.intact for r in found)
    starts = sorted((r.start, r.n_tokens, r.doc_id) for r in found)
    assert [s for s, _, _ in starts] == np.cumsum([0] + [n for _, n, _ in starts])[:-1].tolist() and [d for *_, d in starts] == sorted(d for *_, d in starts)


def test_shards_place_every_row(rows):
    got = sharding.assign(rows).collect()
    assert counted((r.doc_id, r.text_crc32) for r in got) == counted((i, zlib.crc32(text_of(t).encode())) for i, t in KNOWN)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_near_duplicates_are_one_row_for_each_document(rows):
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(rows).collect()}
    smallest = {i: min(text_of(t) for j, t in KNOWN if j == i) for i, _ in KNOWN}
    assert set(got) == set(smallest) and all(got[i] == 0 for i in range(20)) and got[51] == 51 and got[50] == 50
    kept = near_dup.keep_one(rows)
    assert kept.columns == rows.columns and kept.where("doc_id IS NULL").count() == 1 and kept.where("doc_id = 50").count() == 2 and kept.where("doc_id < 20").count() == 1


def test_repeated_vectors_count_each(spark):
    v = np.random.default_rng(3).standard_normal((6, 8)).tolist()
    made = [(1, v[0]), (1, v[0]), (2, v[0]), (3, v[1]), (4, None), (4, None), (5, [])]
    for parts in (1, 4):
        got = pivots.link(spark.createDataFrame([(i, x, "c", 1) for i, x in made], "vec_id long, embedding array<double>, unit string, entry int").repartition(parts)).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (4, 0, 4), (5, 0, 5)]


def test_scores_of_awkward_rows(spark, rows):
    bad = [(1000 + i, invented(i, 40) + " you idiot!" * (i % 3 == 0)) for i in range(120)]
    labels = spark.createDataFrame([(i, int("idiot" in t)) for i, t in bad] + [(None, 1), (1001, None), (1002, 7)], "doc_id long, toxic int")
    every = rows.unionByName(spark.createDataFrame([(i, t) for i, t in bad], "doc_id long, text string"), allowMissingColumns=True)
    got = toxicity.score(every, labels).collect()
    assert counted(r.doc_id for r in got) == counted(i for i, _ in [*KNOWN, *bad]) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    kept = toxicity.drop_toxic(every, labels)
    assert kept.columns == every.columns and kept.where("doc_id IS NULL").count() == 1 and kept.where("doc_id < 1000").count() == len(KNOWN)
    assert kept.where("doc_id >= 1000 AND text LIKE '%idiot%'").count() <= 4


def test_substrings_of_repeated_rows(rows):
    """Rows of one doc_id never remove each other's words."""
    ids = {i for i, _ in KNOWN}
    once = [(i, t) for i, t in KNOWN if sum(j == i for j, _ in KNOWN) == 1]
    assert len(once) < len(KNOWN) and ids
    got = substrings.cut_repeats(rows).collect()
    assert counted(r.doc_id for r in got) == counted(i for i, _ in KNOWN)
    want = brute_substrings([(i, COPY) for i in range(20)] + [(i, t) for i, t in once if i >= 20])
    for r in got:
        if r.doc_id in want and r.doc_id not in (50, 51, 61):
            assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id]


def test_packing_packs_every_row(rows):
    got = packing.pack(rows).collect()
    encoder = Encoder.of(tokenizer_path())
    assert counted(r.doc_id for r in got if r.start == 0) == counted(i for i, _ in KNOWN)
    want = sum(len(encoder.whole([text_of(t).encode()])[0]) // 4 + 1 for _, t in KNOWN)
    assert sum(r.length for r in got) == want
    spots = sorted((r.sequence_id, r.offset, r.length) for r in got)
    for (s, o, n), (s2, o2, _) in zip(spots, spots[1:], strict=False):
        assert (o2 == o + n) if s == s2 else (s2 == s + 1 and o2 == 0)


def test_packing_is_close_to_the_best(spark):
    """Few items, packed by trying all orders: the plan needs no more windows than the best."""
    from itertools import permutations

    r = np.random.default_rng(5)
    for _ in range(30):
        sizes = r.integers(1, 10, 6).tolist()

        def windows(order):
            n, room = 0, 0
            for size in order:
                if size > room:
                    n, room = n + 1, 10
                room -= size
            return n

        best = min(map(windows, set(permutations(sizes))))
        assert sum(times for _, times in packing.packing_plan(dict(Counter(sizes)), 10)) <= best + (best > 3)


def test_scan_of_awkward_rows(spark, rows):
    items = [(1, SHARED), (None, "null id " + SHARED), (2, None), (2, ""), (1, SHARED)]
    bench = spark.createDataFrame([(i, t, "w") for i, t in items], "item_id long, text string, window string")
    got = decontamination.scan(rows, bench).collect()
    assert counted(r.doc_id for r in got) == counted(i for i, _ in KNOWN)
    want = brute_scan([(k, t) for k, (_, t) in enumerate(KNOWN)], [(1, SHARED)])
    assert counted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == counted((KNOWN[k][0], n, hit, tuple(found)) for k, (n, hit, found) in want.items())
    clean = decontamination.remove_contaminated(rows, bench)
    assert clean.columns == rows.columns and clean.where("doc_id IS NULL").count() == 1 and clean.where("doc_id IN (53, 54)").count() == 0


def test_lines_of_awkward_rows(rows):
    got = lines.drop_repeated_lines(rows).collect()
    holders = brute_lines([(i, t) for i, t in KNOWN])
    for r in got:
        if sum(i == r.doc_id for i, _ in KNOWN) == 1:
            assert (r.n_lines, r.n_dropped, r.kept) == holders[r.doc_id]
    whole = lines.without_repeated_lines(rows)
    assert whole.columns == rows.columns and whole.count() == len(REPEATED) and whole.where("text IS NULL").count() == 2 and whole.where("kept = 'k'").count() == len(REPEATED)


# ---------------------------------------------------------------------------------------------------------- pipeline


def tables(spark, folder, documents, labels, benchmark):
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long, kept string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_is_its_stages_by_brute_force(spark, tmp_path):
    """Each stage's rows worked out from what the stage before has left, by other means than the operators'."""
    texts = {i: invented(i, 60) for i in range(160)}
    for i in range(0, 160, 4):
        texts[i] += " you idiot, you worthless loser!"
    for i in range(1, 60, 4):
        texts[i] = f"{LINE}\n{texts[i]}"
    for i in range(3, 40, 4):
        texts[200 + i] = texts[i] + " tail"
    texts[150] = texts[150] + " " + SHARED
    texts[998], texts[999] = None, ""
    documents = [(i, t, "en", "s", len(t or ""), "k") for i, t in texts.items()]
    labels = [(i, 1, int("idiot" in (t or ""))) for i, t in texts.items() if i < 120]
    folder = tables(spark, tmp_path, documents, labels, [(1, SHARED)])

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = dict(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        got = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept"]
        if name == "toxicity":
            want = {i: t for i, t in left.items() if "idiot" not in (t or "")}
        elif name == "line dedup":
            want = {i: (None if left[i] is None else kept) for i, (_, _, kept) in brute_lines(list(left.items())).items()}
        elif name == "MinHash near-dedup":
            want = {i: t for i, t in left.items() if not (200 <= i < 300 and i - 200 in left)}
        else:
            want = {i: t for i, t in left.items() if SHARED not in (t or "")}
        assert got == want, name
        left = want
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    encoder, end = Encoder.of(tokenizer_path()), np.array([2], "<u4").tobytes()
    assert {(r.doc_id, r.ids_crc32) for r in packed} == {(i, zlib.crc32(encoder.whole([text_of(t).encode()])[0] + end)) for i, t in left.items()}
    whole = corpus_pipeline.run(spark, folder).collect()
    assert {(r.doc_id, r.start, r.length) for r in whole} == {(r.doc_id, r.start, r.length) for r in packed}


def test_pipeline_of_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [], [], [])).count() == 0
    assert re.fullmatch("[a-z ]+", corpus_pipeline.STAGES[0][0]) and F.lit is not None
