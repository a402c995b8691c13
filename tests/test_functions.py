"""Scalar functions on invented values: expected results computed by hand or from the published formulas."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from caseframe.functions import checksums, dates, domains, fields, issuer, names, similarity, text, zone


@pytest.fixture(scope="module")
def one(spark):
    frame = spark.range(1)

    def value(column):
        return frame.select(column.alias("v")).first().v

    return value


L = F.lit


def test_text(one):
    assert one(text.fold(L(" Ёлка,  ель. "))) == "ЕЛКА, ЕЛЬ"
    assert one(text.digits(L("№ 12-34"))) == "1234"
    assert one(text.phone_digits(L("8 (999) 000-00-00"))) == one(text.phone_digits(L("+79990000000"))) == "79990000000"
    assert one(text.to_punycode(L("пример.рф"))) == "xn--e1afmkfd.xn--p1ai"
    assert one(text.to_unicode(L("xn--e1afmkfd.xn--p1ai"))) == "пример.рф"
    assert one(text.split_emails(L("<A@b.cd>; a@b.cd, x"))) == ["a@b.cd"]
    assert one(text.split_hosts(L("https://A.b/x, a.b c."))) == ["a.b"]
    assert one(text.first_present(L(None).cast("string"), L(""), L("x"))) == "x"


@pytest.mark.parametrize(
    "given, expected",
    [
        ("27 апреля 1988 года", date(1988, 4, 27)), ("28.06.19", None), ("20.01:2018", date(2018, 1, 20)), ("31.02.2020 и 01.03.2020", None),
        ("01.02.2020, 3 мая 2019", date(2020, 2, 1)), ("", None), (None, None),
    ],
)
def test_parse_date(one, given, expected):
    assert one(dates.parse_date(L(given).cast("string"))) == expected


def test_dates_in_words(one):
    assert one(dates.parse_date_words(L("седьмое августа две тысячи двадцать шестого года"))) == date(2026, 8, 7)
    assert one(dates.parse_date_words(L("«15» мая 2021 г."))) == date(2021, 5, 15)
    assert one(dates.two_digit_year(L("90"), L("03"), L("15"), date(2026, 1, 1))) == date(1990, 3, 15)
    assert one(dates.iso_to_dmy(L("2025-11-20 10:00:00"))) == "20.11.2025"


def test_checksums(one):
    valid = {"9900000017": True, "9900000018": False, "990000000115": True, "990000000116": False, "12": False, "": False}
    assert {k: one(checksums.tax_number_valid(L(k))) for k in valid} == valid
    assert one(checksums.document_number(L("4509 № 000000"))) == "4509 000000" and one(checksums.document_number(L("45"))) is None
    assert one(checksums.luhn_valid(L("4111111111111111"))) and not one(checksums.luhn_valid(L("4111111111111112")))


def test_similarity(one):
    assert round(one(similarity.indel_ratio(L("ТЕСТОВ"), L("ТЕСТОВА"))), 2) == 92.31
    assert round(one(similarity.indel_ratio(L("ИВАНОВ"), L("ПЕТРОВ"))), 2) == 33.33
    assert one(similarity.indel_ratio(L(""), L(""))) == 100 and one(similarity.indel_ratio(L("a"), L(""))) == 0
    assert round(one(similarity.ratio(L("ТЕСТОВ"), L("ТЕСТОВА"))), 2) == 92.31
    assert one(similarity.partial_ratio(L("abc"), L("xxabcxx"))) == 100
    assert one(similarity.token_set_ratio(L("b a c"), L("a b"))) == 100
    found = one(similarity.best_alignment(L("abc"), L("xxabcxx")))
    assert (found.score, found.start, found.end) == (100, 2, 5)
    assert one(similarity.within_edits(L("кот"), L("кит"), 1)) == 1 and one(similarity.within_edits(L("кот"), L("китов"), 1)) is None


def test_names(one):
    assert one(names.gender(L("Петровича"))) == "masc" and one(names.gender(L("Петровной"))) == "femn" and one(names.gender(L("Пётр"))) is None
    assert one(names.ordered(names.split_name(L("Пётр Сергеевич Тестов")))) == ["Тестов", "Пётр", "Сергеевич"]
    assert one(names.extract_name(L("гражданина Тестова Петра Сергеевича, паспорт"))) == ["Тестова", "Петра", "Сергеевича"]
    assert one(names.to_nominative(L("Тестова Петра Сергеевича"))) == "ТЕСТОВ ПЕТР СЕРГЕЕВИЧ"
    assert one(names.name_similarity(L("Тестова Петра Сергеевича"), L("ТЕСТОВ ПЁТР СЕРГЕЕВИЧ"))) == 100
    assert one(names.name_similarity(L("Тестов П"), L("ТЕСТОВ ПЕТР"))) == 100
    assert one(names.name_similarity(L("Тестов"), L("ТЕСТОВ ПЕТР"))) == 50
    assert one(names.name_similarity(L(""), L("ТЕСТОВ"))) == 0


def test_fields(one):
    status = lambda kind, a, b, **o: one(fields.same(kind, L(a), L(b), **o)).status
    assert status("phone", "8 (999) 000-00-00", "+79990000000") == "ok"
    assert status("country", "RUS", "Россия", alpha3={"RUS": "RU"}) == "ok"
    assert status("org", "ООО «Ромашка»", 'ОБЩЕСТВО С ОГРАНИЧЕННОЙ ОТВЕТСТВЕННОСТЬЮ "РОМАШКА"') == "ok"
    assert status("org", "ООО Ромашка", "Ромашка") == "warn" and status("org", "ООО Ромашка", "АО Ромашка") == "fail"
    assert status("house", "Д. 11", "дом 11") == "ok" and status("house", "11 к1", "11") == "warn" and status("house", "11", "12") == "fail"
    assert status("street", "ул. Промышленная", "Промышленная улица") == "ok" and status("street", "ул. Промышленная", "пр. Промышленная") == "warn"
    assert status("date", "01.02.2020", "1 февраля 2020") == "ok" and status("text", "", "x") == "" and status("digits", "12 3", "124") == "fail"


def test_issuers(one):
    assert one(issuer.issuer_similarity(L("ОВД г. Тестова"), L("Отдел внутренних дел города Тестова"))) == 100
    assert one(issuer.region_code(L("770-001"), {"77": "50"})) == "50" and one(issuer.region_code(L("77"), {})) is None
    assert one(issuer.regions_in(L("УВД по городу Тестову"), {"01": ("ТЕСТОВ",), "02": ("УВД$",), "03": ("НЕТ",)})) == ["01", "02"]


def test_repair_words(spark):
    words = spark.createDataFrame([("ПОЛИЦИN",), ("ОТДЕЛ",), ("ААААА",)], "word string")
    vocabulary = spark.createDataFrame([("ПОЛИЦИИ",), ("ОТДЕЛ",), ("ОТДЕЛА",)], "word string")
    assert {r.word: r.repaired for r in issuer.repair_words(words, vocabulary).collect()} == {"ПОЛИЦИN": "ПОЛИЦИИ", "ОТДЕЛ": "ОТДЕЛ", "ААААА": "ААААА"}


def test_domains(spark, one):
    assert one(domains.find_domains(L("домена a-b.ru, почта x@mail.ru"))) == ["a-b.ru"]
    assert one(domains.find_domains(L("www.Тест.рф и тест.рф; 10.20"))) == ["тест.рф"]
    rows = {"info-\nstore.ru": ["info-store.ru"], "a.ru,\nb.ru": ["a.ru", "b.ru"], "": []}
    got = spark.createDataFrame([(k,) for k in rows], "t string").withColumn("j", domains.join_wrapped("t")).withColumn("d", domains.domain_list(F.col("j")))
    assert {r.t: r.d.domains for r in got.collect()} == rows
    whole = spark.createDataFrame([("info-dvd.ru-\nnext",)], "t string").select(domains.join_wrapped("t").alias("j")).first().j
    assert (whole.text, whole.joined) == ("info-dvd.ru-\nnext", [])  # what stands left is a name already
    assert one(domains.stated_count(L("всего 76 доменов"))) == 76 and one(domains.stated_count(L("всего три домена"))) == 3 and one(domains.stated_count(L("x"))) is None
    assert one(domains.mixed_alphabets(F.array(L("aб.ru"), L("ab.com")))) == ["aб.ru"]


@pytest.mark.parametrize(
    "given, expected, joined",
    [
        ("info-\nstore.ru", "info-store.ru", ["info-store.ru"]), ("my-\nbig-\nshop.ru", "my-big-shop.ru", ["my-big-shop.ru"]), ("shop.\nru, a.com", "shop.ru, a.com", ["shop.ru"]), ("shop\n.ru", "shop.ru", ["shop.ru"]),
        ("info-dvd.ru-\nnext", "info-dvd.ru-\nnext", []), ("ab\u00ad\ncd.ru", "abcd.ru", ["abcd.ru"]), ("x@mail-\nbox.ru", "x@mail-\nbox.ru", []), ("слово. Новое", "слово. Новое", []), ("a- b.ru", "a-b.ru", ["a-b.ru"]), ("a – b.ru", "a – b.ru", []), ("", "", []),
    ],
)
def test_names_joined_over_line_ends(given, expected, joined):
    """Values that must be as they are: what breaks a name, and what keeps two names apart."""
    assert domains._join(given) == (expected, joined)


def test_stated_counts(spark):
    """Values that must be as they are: which numbers a text states of its names."""
    rows = {
        "всего 76 (семьдесят шесть) доменов": 76, "в количестве 3 шт.": 3, "Итого: 5": 5, "количество доменов — 7": 7, "5 (пять) доменов": 5, "5 шт. доменов": 5, "всего двадцать пять (доменов": 25, "всего 76.ru": None, "12345 доменов": None,
        "всего много доменов": None, "имя 3. доменов": None, "домен": None,
    }
    got = spark.createDataFrame([(k,) for k in rows], "t string").select("t", domains.stated_count("t").alias("n")).collect()
    assert {r.t: r.n for r in got} == rows


def test_best_window_is_that_of_all_windows():
    import random

    r = random.Random(4)
    for _ in range(400):
        short, long = ("".join(r.choice("abc ") for _ in range(n)) for n in (r.randint(1, 6), r.randint(6, 30)))
        windows = [similarity._row_ratio(short, long[max(e - len(short), 0) : min(e, len(long))]) for e in range(1, len(long) + len(short))]
        score, a, z = similarity._best_window(short, long)
        assert score == max(windows) and similarity._row_ratio(short, long[a:z]) == score


def test_zone(spark):
    rows = [("p", 1, "noise"), ("p", 2, "PNRUSTESTOV<<P2TR<SERGEEVI3<<<<<<<<<<<<<<<<<"), ("p", 3, "4500000003RUS9003152M<<<<<<<9100420770001<52")]
    found = zone.zone_lines(spark.createDataFrame(rows, "page string, n int, line string"), ["page"], "n", "line")
    r = zone.parse_zones(found, ["page"], 2026).first()
    assert (r.series + " " + r.number, r.birth_date, r.issue_date, r.department_code) == ("4509 000000", "15.03.1990", "20.04.2010", "770-001")
    assert (r.surname, r.given_name, r.patronymic, r.sex, r.valid, r.failed) == ("ТЕСТОВ", "ПЁТР", "СЕРГЕЕВИЧ", "М", True, [])
