"""Issuers: repair of misread words by vocabulary and neighbours, regions by cities and kinds; pairs within edits against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from caseframe.functions import issuer
from caseframe.operators import likeness

VOCABULARY = "МВД УФМС ОТДЕЛЕНИЕМ РОССИИ ОБЛАСТИ РАЙОНЕ РАЙОНА РАЙОНУ КРАЮ ПО В МИЛИЦИИ ПОЛИЦИИ АДМИНИСТРАТИВНОМ".split()
REGIONS = {"50": (("МОСКОВСК",), None), "55": (("ОМСК",), "ОМСК"), "40": (("КАЛУЖСК",), "КАЛУГА"), "59": (("ПЕРМСК",), "ПЕРМЬ"), "16": (("ТАТАРСТАН",), "КАЗАНЬ"), "04": (("АЛТАЙ$",), None), "22": (("АЛТАЙСК",), "БАРНАУЛ"), "24": (("КРАСНОЯРСК",), "КРАСНОЯРСК")}


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_pairs_within_edits_are_all_of_them(spark, most):
    draw = random.Random(most)
    word = lambda: "".join(draw.choice("абв") for _ in range(draw.randint(1, 7)))
    left, right = {word() for _ in range(60)}, {word() for _ in range(60)}
    found = likeness.pairs_within_edits(spark.createDataFrame([(w,) for w in left], "x string"), spark.createDataFrame([(w,) for w in right], "y string"), [], "x", "y", most)
    assert {(r.x, r.y): r.edits for r in found.collect()} == {(a, b): d for a in left for b in right if a != b and (d := edits(a, b)) <= most}


def repaired(spark, texts: list[str | None], neighbours=None, known=None) -> list[tuple]:
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, body string").withColumnRenamed("i", "id")
    words = spark.createDataFrame([(w,) for w in VOCABULARY], "word string")
    pairs = spark.createDataFrame(neighbours, "left string, right string, n int") if neighbours else None
    lexicon = spark.createDataFrame([(w,) for w in known], "word string") if known else None
    found = issuer.repair_in_context(frame, ["id"], "body", words, pairs, lexicon).orderBy("id").collect()
    return [(r.text, [(f.word, f.repaired) for f in r.fixes]) for r in found]


def test_misread_words(spark):
    got = repaired(spark, ["МВД РООСИИ ПО МОСКОВСКОЙ ВЛАСТИ", "ОТДЕЛЕНИЕМ УФМС  России, по ПЕРМСКОМУ КРАЮ В ОСИНСКОМ РАЙОНЕ.", "АДМИИСТРАТИВНОН, КРАИ", None, ""], known=["ВЛАСТИ"])
    assert got[0] == ("МВД РОССИИ ПО МОСКОВСКОЙ ОБЛАСТИ", [("РООСИИ", "РОССИИ"), ("ВЛАСТИ", "ОБЛАСТИ")])
    assert got[1] == ("ОТДЕЛЕНИЕМ УФМС  РОССИИ, ПО ПЕРМСКОМУ КРАЮ В ОСИНСКОМ РАЙОНЕ.", [])
    assert got[2] == ("АДМИНИСТРАТИВНОМ, КРАИ", [("АДМИИСТРАТИВНОН", "АДМИНИСТРАТИВНОМ")]) and got[3:] == [("", []), ("", [])]
    assert repaired(spark, ["ПО ВЛАСТИ"], known=["ВЛАСТИ"]) == [("ПО ВЛАСТИ", [])]


def test_neighbours_decide_between_equally_near_words(spark):
    texts = ["В РАЙОНХ ТЕСТА", "ПО РАЙОНХ", "ОТДЕЛ РАЙОНХ МИЛИЦИИ"]
    assert [t for t, _ in repaired(spark, texts)] == texts
    pairs = [("В", "РАЙОНЕ", 5), ("В", "РАЙОНА", 2), ("В", "РАЙОНА", 1), ("ПО", "РАЙОНУ", 3), ("ПО", "РАЙОНЕ", 3), ("РАЙОНА", "МИЛИЦИИ", 1)]
    assert [t for t, _ in repaired(spark, texts, pairs)] == ["В РАЙОНЕ ТЕСТА", "ПО РАЙОНХ", "ОТДЕЛ РАЙОНА МИЛИЦИИ"]


@pytest.mark.parametrize(("body", "codes"), [
    ("ГУ МВД РОССИИ ПО МОСКОВСКОЙ ОБЛАСТИ", ["50"]), ("ОТДЕЛОМ ВНУТРЕННИХ ДЕЛ МОСКОВСКОГО ОКРУГА ГОРОДА КАЛУГИ", ["40"]), ("ОУФМС РОССИИ ПО ОМСКОЙ ОБЛ. В КИРОВСКОМ АДМИНИСТРАТИВНОМ ОКРУГЕ ГОРОДА ОМСКА", ["55"]),
    ("ОТДЕЛЕНИЕМ УФМС РОССИИ ПО ПЕРМСКОМУ КРАЮ В ОСИНСКОМ РАЙОНЕ", ["59"]), ("по республике татарстан", ["16"]), ("ОТДЕЛ РЕСПУБЛИКИ АЛТАЙ", ["04"]), ("ПО АЛТАЙСКОМУ КРАЮ", ["22"]), ("ПО КРАСНОЯРСХОМУ КРАЮ", ["24"]),
    ("ТП ГОР. МОСКВЕ", ["77"]), ("ПО ТОМСКОЙ ОБЛ", []), ("ОМСКОЙ", []), (None, []), ("", []),
])
def test_regions_that_a_name_names(spark, body, codes):
    row = spark.createDataFrame([(body,)], "b string").select(issuer.regions_named(F.col("b"), REGIONS, (("МОСКВ", "77"),)).alias("r")).first()
    assert row.r == codes


def test_cities_in_other_cases():
    assert issuer.city_forms("КАЗАНЬ") == ["КАЗАНЬ", "КАЗАНИ", "КАЗАНЮ", "КАЗАНЕ"] and issuer.city_forms("ИВАНОВО") == ["ИВАНОВО"]
    assert issuer.city_forms("ГРОЗНЫЙ") == ["ГРОЗНЫЙ", "ГРОЗНОГО", "ГРОЗНОМ", "ГРОЗНОМУ"] and "ОМСКОМ" in issuer.city_forms("ОМСК") and "УФОЙ" in issuer.city_forms("УФА")


def test_neighbours_of_a_key_count_for_its_texts_only(spark):
    texts = spark.createDataFrame([(1, "МОСКОВСКОЙ, РАЙОНХ"), (2, "МОСКОВСКОЙ, РАЙОНХ")], "id int, body string")
    words = spark.createDataFrame([("РАЙОНА",), ("РАЙОНЕ",)], "word string")
    pairs = spark.createDataFrame([(1, "МОСКОВСКОЙ", "РАЙОНА", 1)], "id int, left string, right string, n int")
    found = issuer.repair_in_context(texts, ["id"], "body", words, pairs).orderBy("id").collect()
    assert [r.text for r in found] == ["МОСКОВСКОЙ, РАЙОНА", "МОСКОВСКОЙ, РАЙОНХ"]
