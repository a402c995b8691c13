"""Queries over the driver's tables for operators whose inputs (letters, names, registry pages) those tables don't hold.

Every row of a table gets one of a few known inputs by its key, with the key written into it where it says {n}; the SQL states what has
to come out for each, over the same whole table. So each operator runs on every row, and its results are compared with
values that were worked out by hand.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseframe.functions import checksums, dates, domains, fields, issuer, names, similarity, text, zone
from caseframe.operators import steps, words
from caseframe.plans import answers, forms, owners, sections
from caseframe.queries import ORACLE_SQL, QUERIES, spread, table
from caseframe.sources import html, registries

Row = tuple[str, Sequence[object]]


def _sql_value(v: object) -> str:
    if v is None:
        return "NULL"
    quoted = "'" + str(v).replace("'", "''") + "'"
    return "E" + quoted.replace("\\", "\\\\").replace("\n", "\\n") if "\n" in quoted or "\\" in quoted else quoted


def expected_sql(source: str, key: str, outputs: Sequence[str], rows: Sequence[Sequence[object]]) -> str:
    """key and the outputs (as texts) of each row of a table, by key modulo the number of rows."""
    columns = []
    for i, name in enumerate(outputs):
        cases = " ".join(f"WHEN {k} THEN {_sql_value(r[i])}" for k, r in enumerate(rows))
        columns.append(f"replace(CAST(CASE {key} % {len(rows)} {cases} END AS VARCHAR), '{{n}}', CAST({key} AS VARCHAR)) AS {name}")
    return f"SELECT {key}, {', '.join(columns)} FROM {source}"


def inputs(df: DataFrame, key: str, given: Sequence[str | None], name: str = "given") -> DataFrame:
    """The table's key and one of the given texts with the key written in."""
    chosen = F.get(F.array(*(F.lit(g).cast("string") for g in given)), F.col(key) % len(given))
    return spread(df.select(key)).select(key, F.replace(chosen, F.lit("{n}"), F.col(key).cast("string")).alias(name))


def planted(source: str, key: str, outputs: Sequence[str], rows: Sequence[Row]):
    """Registers a query: the function gets (rows with key and given) and returns key and the outputs, or Columns for them by name."""

    def register(f: Callable):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            df = inputs(table(spark, sf, source), key, [r[0] for r in rows])
            made = f(df)
            made = df.select(key, *(c.alias(n) for n, c in made.items())) if isinstance(made, Mapping) else made
            return made.select(key, *(_text(F.col(n)).alias(n) for n in outputs))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        ORACLE_SQL[f.__name__] = expected_sql(source, key, outputs, [r[1] for r in rows])
        return f

    return register


def _text(c: Column) -> Column:
    return c.cast("string")


def _from_one(df: DataFrame, found: Column, columns: Mapping[str, Column]) -> DataFrame:
    """The key and Columns of `found`, which is a step of its own: Columns that hold it would repeat all of it, in the plan and for
    each row."""
    key = df.columns[0]
    return df.select(key, found.alias("found")).select(key, *(c.alias(n) for n, c in columns.items()))


def _listed(c: Column) -> Column:
    return F.array_join(c, "|")


# ---------------------------------------------------------------------------------------------------------------
# names


@planted("customer", "c_custkey", ("parts", "nominative", "of"), [
    ("Тестов Пётр Сергеевич, паспорт 4509 {n}", ("Тестов|Пётр|Сергеевич", "ТЕСТОВ ПЕТР СЕРГЕЕВИЧ", "masc")),
    ("гражданина Тестова Петра Сергеевича 15.03.1990 года рождения", ("Тестова|Петра|Сергеевича", "ТЕСТОВ ПЕТР СЕРГЕЕВИЧ", "masc")),
    ("Пётр Сергеевич Тестов", ("Тестов|Пётр|Сергеевич", "ТЕСТОВ ПЕТР СЕРГЕЕВИЧ", "masc")),
    ("Ивановой Анны Сергеевны, адрес {n}", ("Ивановой|Анны|Сергеевны", "ИВАНОВА АННА СЕРГЕЕВНА", "femn")),
    ("{n}", ("", "", None)),
])
def person_names(df: DataFrame) -> DataFrame:
    """Names taken out of running text, in the order surname first, and in the nominative."""
    found = F.col("found")
    columns = {"parts": _listed(found), "nominative": names.to_nominative(F.array_join(found, " ")), "of": F.when(F.size(found) == 3, names.gender(F.element_at(found, -1)))}
    return _from_one(df, names.ordered(names.extract_name("given")), columns)


@planted("customer", "c_custkey", ("score", "patronymic", "misread"), [
    ("Тестова Петра Сергеевича;ТЕСТОВ ПЁТР СЕРГЕЕВИЧ", ("100.0", "true", "false")), ("Тестов П;ТЕСТОВ ПЕТР", ("100.0", "false", "false")), ("Тестов;ТЕСТОВ ПЕТР", ("50.0", "false", "false")),
    (";ТЕСТОВ", ("0.0", "false", "false")), ("Тестов Петр Сергеевич;ТЕСТОВ ПЕТРП СЕРГЕЕВИЧ", ("96.3", "true", "true")), ("Жук;ШМЕЛ", ("0.0", "false", "false")),
])
def person_name_likeness(df: DataFrame) -> dict[str, Column]:
    """Similarity of a stated and a read name; whether they differ by a misread letter only."""
    a, b = F.split_part("given", F.lit(";"), F.lit(1)), F.split_part("given", F.lit(";"), F.lit(2))
    last = names.is_patronymic(F.coalesce(F.element_at(names.split_name(b), -1), F.lit("")))
    return {"score": F.round(names.name_similarity(a, b), 1), "patronymic": F.coalesce(last, F.lit(False)), "misread": F.coalesce(names.reading_error_only(a, b, ("ПЕТР", "СЕРГЕЕВИЧ")), F.lit(False))}


# ---------------------------------------------------------------------------------------------------------------
# dates, numbers, zones


@planted("orders", "o_orderkey", ("written", "worded"), [
    ("27 апреля 1988 года № {n}", ("27.04.1988", "27.04.1988")), ("28.06.19", (None, None)), ("20.01:2018, {n}", ("20.01.2018", "20.01.2018")), ("31.02.2020 и 01.03.2020", (None, None)),
    ("01.02.2020, 3 мая 2019", ("01.02.2020", "01.02.2020")), ("{n}", (None, None)), ("седьмое августа две тысячи двадцать шестого года", (None, "07.08.2026")), ("«15» мая 2021 г.", (None, "15.05.2021")),
])
def dates_in_letters(df: DataFrame) -> dict[str, Column]:
    """Dates in figures and in words."""
    return {"written": dates.dmy(dates.parse_date("given")), "worded": dates.dmy(dates.parse_date_words("given"))}


@planted("orders", "o_orderkey", ("iso", "full_year", "number", "tax"), [
    ("2025-11-20 10:00:00;900315;4509 № 000000;9900000017", ("20.11.2025", "15.03.1990", "4509 000000", "true")), ("20.11.2025;250101;45 10 123456;9900000018", ("20.11.2025", "01.01.2025", "4510 123456", "false")),
    (";991332;45;990000000115", ("", None, None, "true")), ("x;;4509000001;12", ("x", None, "4509 000001", "false")),
])
def dates_and_numbers(df: DataFrame) -> dict[str, Column]:
    """Dates of registries, two-digit years, document and tax numbers."""
    part = lambda i: F.split_part("given", F.lit(";"), F.lit(i))
    short = [F.substring(part(2), i, 2) for i in (1, 3, 5)]
    return {"iso": dates.iso_to_dmy(part(1)), "full_year": dates.dmy(dates.two_digit_year(*short, date(2026, 1, 1))), "number": checksums.document_number(part(3)), "tax": checksums.tax_number_valid(part(4))}


@planted("part", "p_partkey", ("surname", "given_name", "patronymic", "number", "born", "issued", "department", "valid", "changes", "failed"), [
    ("PNRUSTESTOV<<P2TR<SERGEEVI3<<<<<<<<<<<<<<<<<\n4500000003RUS9003152M<<<<<<<9100420770001<52", ("ТЕСТОВ", "ПЁТР", "СЕРГЕЕВИЧ", "4509 000000", "15.03.1990", "20.04.2010", "770-001", "true", "0", "")),
    ("PNRUSTESTOV<<P2TR<SERGEEVI3<<<<<<<<<<<<<<<<<\n4500000003RUS9003152M<<<<<<<91O0420770001<52", ("ТЕСТОВ", "ПЁТР", "СЕРГЕЕВИЧ", "4509 000000", "15.03.1990", "20.04.2010", "770-001", "true", "0", "")),
    ("noise {n}\nmore noise", (None,) * 10),
])
def machine_zones(df: DataFrame) -> DataFrame:
    """Two-line zones among a page's lines, decoded with their check digits."""
    lines = df.select("p_partkey", F.posexplode(F.split("given", "\n")).alias("n", "line"))
    z = zone.parse_zones(zone.zone_lines(lines, ["p_partkey"], "n", "line"), ["p_partkey"], 2026)
    own = z.select("p_partkey", "surname", "given_name", "patronymic", F.concat_ws(" ", "series", "number").alias("number"), F.col("birth_date").alias("born"), F.col("issue_date").alias("issued"), F.col("department_code").alias("department"), "valid", F.col("corrections").alias("changes"), F.array_join("failed", ",").alias("failed"))
    return df.select("p_partkey").join(own, "p_partkey", "left")


# ---------------------------------------------------------------------------------------------------------------
# comparison of two sources

_PAIRS = [
    ("phone", "8 (999) 000-00-00", "+79990000000", "ok"), ("phone", "8 (999) 000-00-00", "9990000001", "fail"), ("country", "RUS", "Россия", "ok"), ("country", "DE", "FR", "fail"),
    ("org", "ООО «Ромашка»", 'ОБЩЕСТВО С ОГРАНИЧЕННОЙ ОТВЕТСТВЕННОСТЬЮ "РОМАШКА"', "ok"), ("org", "ООО Ромашка", "Ромашка", "warn"), ("org", "ООО Ромашка", "АО Ромашка", "fail"), ("org", "", "Ромашка", ""),
    ("house", "Д. 11", "дом 11", "ok"), ("house", "11 к1", "11", "warn"), ("house", "11", "12", "fail"), ("house", "11 а", "11А", "ok"),
    ("street", "ул. Промышленная", "Промышленная улица", "ok"), ("street", "ул. Промышленная", "пр. Промышленная", "warn"), ("street", "ул. Мира", "ул. Садовая", "fail"),
    ("date", "01.02.2020", "1 февраля 2020", "ok"), ("date", "01.02.2020", "02.02.2020", "fail"), ("text", "", "x", ""), ("text", "Ёлка, ель", "елка ель", "ok"), ("digits", "12 3", "124", "fail"), ("digits", "12-3", "123", "ok"),
    ("issuer", "ОВД г. Тестова", "Отдел внутренних дел города Тестова", "warn"), ("issuer", "ОВД г. Тестова", "ТП № 5", "fail"), ("issuer", "ОВД", "овд", "ok"),
]


@planted("supplier", "s_suppkey", ("status",), [("{k};{a};{b}".format(k=k, a=a, b=b), (s,)) for k, a, b, s in _PAIRS])
def compare_by_kind(df: DataFrame) -> dict[str, Column]:
    """Two sources' values of each kind: telephone, country, organisation, house, street, date, text, digits, issuer."""
    kind, a, b = (F.split_part("given", F.lit(";"), F.lit(i)) for i in (1, 2, 3))
    out = F.lit(None).cast("string")
    for k in dict.fromkeys(p[0] for p in _PAIRS):
        out = F.when(kind == k, fields.same(k, a, b, **({"alpha3": {"RUS": "RU"}} if k == "country" else {}))["status"]).otherwise(out)
    return {"status": out}


@planted("supplier", "s_suppkey", ("forms", "name", "street", "house"), [
    ("ООО «Ромашка»;ул. Садовая;д. 5 корпус 2", ("ООО", "ромашка", "садовая", "5|к|2")), ("Публичное акционерное общество Завод;проспект Мира;11 А стр 3", ("ПАО", "завод", "мира", "11а|стр|3")),
    ("Ромашка ООО;Промышленная улица;дом № 7", ("ООО", "ромашка", "промышленная", "7")), ("Просто имя {n};Мира;{n}", ("", "просто имя {n}", "мира", "{n}")),
])
def parts_of_addresses(df: DataFrame) -> dict[str, Column]:
    """Legal forms and names of organisations, streets without their kinds, house numbers."""
    org, road, building = (F.split_part("given", F.lit(";"), F.lit(i)) for i in (1, 2, 3))
    return {"forms": _listed(fields.organisation(org)["forms"]), "name": fields.organisation(org)["name"], "street": fields.street(road)["name"], "house": _listed(fields.house_key(building))}


@planted("supplier", "s_suppkey", ("alike", "authority", "share", "region", "regions"), [
    ("ОВД г. Тестова;770-001", ("100.0", "true", "0.33", "50", "01")), ("УВД по городу Тестову;010-001", ("87.5", "true", "0.25", "01", "01|02")), ("ничего;12", ("12.5", "false", "0.0", None, "")), (";", ("0.0", "false", None, None, "")),
])
def issuing_authorities(df: DataFrame) -> dict[str, Column]:
    """Names of issuing authorities: likeness, plausibility, share of known words, regions by code and by name."""
    name, code = (F.split_part("given", F.lit(";"), F.lit(i)) for i in (1, 2))
    known = ("ОВД", "УВД")
    alike = issuer.issuer_similarity(name, F.lit("Отдел внутренних дел города Тестова"))
    return {
        "alike": F.round(alike, 1), "authority": issuer.looks_like_authority(name, known), "share": F.round(issuer.vocabulary_share(name, (*known, "Г.")), 2),
        "region": issuer.region_code(code, {"77": "50"}), "regions": _listed(issuer.regions_in(name, {"01": ("ТЕСТОВ",), "02": ("УВД$",), "03": ("НЕТ",)})),
    }


@planted("part", "p_partkey", ("score", "start", "end", "blocks", "edits"), [
    ("abc;xxabcxx", ("100.0", "2", "5", "0.6", None)), ("abcd;xxabXd{n}", (None, None, None, None, None)), ("кот;кит", ("66.7", "0", "3", "0.667", "1")), (";abc", ("0.0", "0", "3", "0.0", None)),
])
def best_windows(df: DataFrame) -> dict[str, Column]:
    """The window of a text most like a quote, matching blocks, and edits where they are few."""
    a, b = (F.split_part("given", F.lit(";"), F.lit(i)) for i in (1, 2))
    known = ~F.col("given").startswith("abcd")
    found = similarity.best_alignment(a, b)
    score = {"score": F.round(found["score"], 1), "start": found["start"], "end": found["end"], "blocks": F.round(similarity.matching_blocks_ratio(a, b), 3), "edits": similarity.within_edits(a, b, 1)}
    return {k: F.when(known, v) for k, v in score.items()}


@planted("nation", "n_nationkey", ("score",), [("b a c;a b", ("100.0",)), ("a b;c d", ("33.3",)), ("ab cd;ab ce", ("80.0",)), (";a", ("0.0",)), ("one two three;three two four", ("81.8",))])
def token_set_scores(df: DataFrame) -> dict[str, Column]:
    """Ratio of two texts by their sets of words."""
    a, b = (F.split_part("given", F.lit(";"), F.lit(i)) for i in (1, 2))
    return {"score": F.round(similarity.token_set_ratio(a, b), 1)}


@planted("customer", "c_custkey", ("phone", "country", "mails", "hosts", "ascii", "native", "word"), [
    ("8 (999) 000-00-00;RUS;<A@b.cd>, a@b.cd, x;https://A.b/x, a.b c.;пример.рф", ("79990000000", "RU", "a@b.cd", "a.b", "xn--e1afmkfd.xn--p1ai", "пример.рф", "пример рф")),
    ("9990000000;Россия;a{n}@b.ru;a{n}.ru;xn--e1afmkfd.xn--p1ai", ("79990000000", "RU", "a{n}@b.ru", "a{n}.ru", "xn--e1afmkfd.xn--p1ai", "пример.рф", "xn e1afmkfd xn p1ai")),
    ("{n};de;;;a.ru", ("{n}", "DE", "", "", "a.ru", "a.ru", "a ru")),
])
def contacts_normalised(df: DataFrame) -> dict[str, Column]:
    """Telephones, countries, address and host lists, and names of hosts in both alphabets."""
    part = [F.split_part("given", F.lit(";"), F.lit(i)) for i in (1, 2, 3, 4, 5)]
    long = F.col("c_custkey") % 3 == 2
    return {
        "phone": F.when(long, text.digits(part[0])).otherwise(text.phone_digits(part[0])), "country": text.country_code(part[1], {"RUS": "RU"}), "mails": _listed(text.split_emails(part[2])), "hosts": _listed(text.split_hosts(part[3])),
        "ascii": text.to_punycode(part[4]), "native": text.to_unicode(part[4]), "word": text.word_key(part[4]),
    }


# ---------------------------------------------------------------------------------------------------------------
# domain names


@planted("pages", "page_id", ("names", "joined", "left_over", "mixed", "stated"), [
    ("домены: info-\nstore.ru, test{n}.рф", ("info-store.ru|test{n}.рф", "info-store.ru", "", "test{n}.рф", None)), ("a{n}.ru,\nb.ru", ("a{n}.ru|b.ru", "", "", "", None)),
    ("info-dvd.ru-\nnext", ("", "", "info-dvd.ru-|next", "", None)), ("www.Тест.рф и тест.рф; 10.20; всего 76 доменов", ("тест.рф", "", "", "", "76")), ("aб.ru, всего три домена", ("aб.ru", "", "", "aб.ru", "3")),
    ("почта x@mail.ru", ("", "", "", "", None)), ("", ("", "", "", "", None)), ("shop.\nru и a.com", ("shop.ru|a.com", "shop.ru", "", "", None)),
])
def domain_lists(df: DataFrame) -> dict[str, Column]:
    """Domain names of letters: joined over line ends, what is left over, mixed alphabets, the number that is stated."""
    found = domains.domain_list(domains.join_wrapped("given"))
    return {"names": _listed(found["domains"]), "joined": _listed(found["joined"]), "left_over": _listed(found["fragments"]), "mixed": _listed(found["mixed"]), "stated": found["stated_count"]}


# ---------------------------------------------------------------------------------------------------------------
# forms

FORM = {
    "id": "transfer", "detect": {"keywords": ["заявление", "домен", "администратор"], "min_hits": 2}, "labels": ["ФИО", "подпись"],
    "fields": {
        "applicant_header": {"type": "fio_date", "text": [r"(?s)\bот\s+(.+?)\n"]}, "applicant_fio": {"type": "fio", "text": [r"Я,\s+(.+?)\n"]}, "passport": {"type": "passport", "text": [r"(?i)паспорт\s*:?\s*(.+?)\n"]},
        "inn": {"type": "inn", "text": [r"ИНН\s+(.+?)\n"]}, "issued_by": {"type": "issuer", "text": [r"(?i)кем выдан\s*:?\s*(.+?)\n"]}, "domains": {"type": "domains", "text": [r"(?s)домены:\s*(.+?)\nНовый"]},
        "new_admin_fio": {"type": "fio_or_org", "text": [r"Новый администратор:\s*(.+?)\n"]}, "new_admin_contact": {"type": "contact", "text": [r"Контакт:\s*(.+?)\n"]}, "application_date": {"type": "date_words", "text": [r"Дата:\s*(.+?)\n"]},
    },
}
_LETTER = (
    "ЗАЯВЛЕНИЕ администратора\nот Тестова Петра Сергеевича, 15.03.1990 г.р.\nЯ, Пётр Сергеевич Тестов\nПаспорт: 4509 000000, дата выдачи 20.04.2010\nИНН 990000000115\n"
    "Кем выдан: ОВД города Тестова\nдомены: info-\nstore.ru, test{n}.рф\nНовый администратор: %s\nКонтакт: a{n}@b.ru, 8 (999) 000-00-00\nДата: седьмое августа две тысячи двадцатого года\n"
)
_FORM_OUT = ("applicant_header", "applicant_header__birth_date", "applicant_fio", "passport", "passport__issue_date", "inn", "issued_by", "domains", "new_admin_fio", "new_admin_fio__kind", "new_admin_contact", "application_date", "review")
_FORM_ROW = ("ТЕСТОВ ПЕТР СЕРГЕЕВИЧ", "15.03.1990", "Тестов Пётр Сергеевич", "4509 000000", "20.04.2010", "990000000115", "ОВД города Тестова", "info-store.ru, test{n}.рф")


@planted("orders", "o_orderkey", _FORM_OUT, [
    (_LETTER % "Пробный Иван Ильич", (*_FORM_ROW, "ПРОБНЫЙ ИВАН ИЛЬИЧ", "person", "a{n}@b.ru, 8 (999) 000-00-00", "07.08.2020", "false")),
    (_LETTER % "ООО «Ромашка»", (*_FORM_ROW, "ООО «Ромашка»", "org", "a{n}@b.ru, 8 (999) 000-00-00", "07.08.2020", "false")), ("ничего {n}", (None,) * 13),
])
def form_fields(df: DataFrame) -> DataFrame:
    """A form's fields of every type out of letters."""
    found = F.col("found")
    columns = {role: found[role.replace("__", ".")]["value"] for role in _FORM_OUT[:-1]}
    columns["review"] = F.aggregate(F.map_values(found), F.lit(None).cast("boolean"), lambda s, f: F.coalesce(s, F.lit(False)) | f["needs_review"])
    return _from_one(df, forms.extract(F.col("given"), forms.load(FORM)), columns)


@planted("orders", "o_orderkey", ("form", "owner", "person", "contact", "block"), [
    (_LETTER % "x", ("transfer", None, None, None, "1")), ("счёт и оплата {n}", ("bill", None, None, None, "0")), ("ничего {n}", (None, None, None, None, "0")),
    ("Новый владелец:\nООО «Ромашка», ИНН 1\nПробный Иван Ильич\na{n}@b.ru\nподпись", (None, "ООО «Ромашка»", "Пробный Иван Ильич", "a{n}@b.ru", "3")),
])
def form_sections(df: DataFrame) -> DataFrame:
    """Which form a letter is, and the section about a new owner."""
    bill = forms.load({"id": "bill", "detect": {"keywords": ["счёт", "оплата"]}, "fields": {}})
    block = forms.section(F.col("given"), {"start": ["(?i)новый владелец:", "(?i)новый администратор:"], "end": ["подпись", "Контакт:"]})
    found = df.select("o_orderkey", forms.detect(F.col("given"), [forms.load(FORM), bill]).alias("form"), block.alias("section"))
    found = found.select("o_orderkey", "form", "section", forms.new_owner_section(F.col("section")).alias("new"))
    lines = F.size(F.filter(F.split(F.coalesce("section", F.lit("")), "\n"), lambda x: F.trim(x) != ""))
    return found.select("o_orderkey", "form", F.col("new.org").alias("owner"), "new.person", F.coalesce("new.contact", "new.org_contact").alias("contact"), lines.alias("block"))


@planted("orders", "o_orderkey", ("passport", "source", "born", "kept"), [
    (_LETTER % "x", ("4510 111111", "manual", "15.03.1990", "990000000115")), ("ничего {n}", ("4510 111111", "manual", None, None)),
])
def operator_edits(df: DataFrame) -> DataFrame:
    """A form's fields with an operator's edits over them."""
    form, edited = forms.load(FORM), F.col("found")
    read = df.select("o_orderkey", forms.extract(F.col("given"), form).alias("read"))
    columns = {"passport": edited["passport"]["value"], "source": edited["passport"]["source"], "born": edited["applicant_header.birth_date"]["value"], "kept": edited["inn"]["value"]}
    return _from_one(read, forms.override(F.col("read"), F.create_map(F.lit("passport"), F.lit("45 10 111111")), form), columns)


# ---------------------------------------------------------------------------------------------------------------
# registries, pages, recognised words


@planted("supplier", "s_suppkey", ("status", "registrar", "created", "till"), [
    ("% comment\ndomain: TEST{n}.RU\nstate: REGISTERED, DELEGATED\nregistrar: R-RU\ncreated: 2020-01-01\npaid-till: 2030-01-01\n", ("registered", "R-RU", "2020-01-01", "2030-01-01")), ("No entries found for x{n}.ru", ("free", None, None, None)), ("???", ("error", None, None, None)),
    ('{"ldhName": "test{n}.com", "status": ["active"], "events": [{"eventAction": "registration", "eventDate": "2020"}, {"eventAction": "expiration", "eventDate": "2030"}], "entities": [{"roles": ["registrar"], "vcardArray": ["vcard", [["fn", {}, "text", "Some Registrar"]]]}]}', ("registered", "Some Registrar", "2020", "2030")),
])
def registry_replies(df: DataFrame) -> dict[str, Column]:
    """Replies of registries as text and as JSON."""
    w, r = registries.parse_whois(F.col("given")), registries.parse_rdap(F.col("given"), F.lit(200))
    json = F.col("given").startswith("{")
    pick = lambda name: F.when(json, r[name]).otherwise(w[name])
    return {"status": pick("status"), "registrar": pick("registrar"), "created": pick("created"), "till": pick("paid_till")}


@planted("customer", "c_custkey", ("kind", "value"), [
    ("user_id={n}", ("id", "{n}")), ("договор № 1{n}11", ("id", "1{n}11")), ("a{n}@b.ru", ("login", "a{n}@b.ru")), ("https://Test{n}.ru/x", ("domain", "test{n}.ru")), ("some_login{n}", ("login", "some_login{n}")), ("", ("", "")), ("два слова", ("", "два слова")),
])
def query_kinds(df: DataFrame) -> dict[str, Column]:
    """What someone typed to find an account."""
    k = registries.query_kind(F.col("given"))
    return {"kind": k["kind"], "value": k["value"]}


_PAGE = (
    "<title> T {n}</title><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>{n}</td></tr><tr><td>x</td></tr></table><table><tr><td>Login:</td><td>me{n}</td></tr></table>"
    "<table><tr><td>g</td><td>f</td><td>v{n}</td></tr><tr><td>g</td><td>secret</td><td>s</td></tr></table><input name=a value={n}><a href='/u'>l</a>"
)


@planted("part", "p_partkey", ("title", "a", "b", "login", "f", "input"), [(_PAGE, ("T {n}", "1", "{n}", "me{n}", "v{n}", "{n}")), ("<p>{n}", (None,) * 6)])
def html_records(df: DataFrame) -> DataFrame:
    """Header rows, labels, groups of fields and named inputs of pages, by lists of what may leave them."""
    # pages are read once, whatever is made of their parts
    parts = steps.written(html.page_parts(df, "p_partkey", "given"), "parts")
    first = {
        "title": parts.where("part = 'title'").select("p_partkey", F.col("value").alias("title")), "record": html.header_records(parts, "p_partkey", ("A", "B")).select("p_partkey", F.col("record.A").alias("a"), F.col("record.B").alias("b")),
        "login": html.label_values(parts, "p_partkey", ("Login",)).select("p_partkey", F.col("value").alias("login")), "group": html.group_fields(parts, "p_partkey", ("f",)).select("p_partkey", F.col("fields.f").alias("f")),
        "inputs": html.inputs(parts, "p_partkey", ("a",)).select("p_partkey", F.col("inputs.a").alias("input")),
    }
    out = df.select("p_partkey")
    for part in first.values():
        out = out.join(part, "p_partkey", "left")
    return out


@planted("part", "p_partkey", ("lines", "page", "conf"), [("a,90,0,0,1;b,80,20,0,1; ,90,40,0,1;c{n},70,0,30,2;d,-1,0,30,2", ("2", "a b\nc{n}", "77.5")), ("z,50,0,0,1", ("1", "z", "50.0"))])
def recognised_lines(df: DataFrame) -> DataFrame:
    """Recognised words to lines and pages; blank and rejected words are left out."""
    w = df.select("p_partkey", F.posexplode(F.split("given", ";")).alias("word", "x")).select("p_partkey", "word", F.split("x", ",").alias("p"))
    n = lambda i: F.col("p")[i].cast("int")
    rows = w.select("p_partkey", "word", F.lit(1).alias("block"), F.lit(1).alias("par"), n(4).alias("line"), F.col("p")[0].alias("text"), F.col("p")[1].cast("double").alias("conf"), n(2).alias("x"), n(3).alias("y"), F.lit(10).alias("w"), F.lit(10).alias("h"))
    lines = words.lines_of(rows, ["p_partkey"])
    return words.page_text(lines, ["p_partkey"]).withColumnRenamed("text", "page").join(lines.groupBy("p_partkey").agg(F.count("*").alias("lines"), F.avg("conf").alias("conf")), "p_partkey")


@planted("part", "p_partkey", ("score",), [("РОССИЙСКАЯ ФЕДЕРАЦИЯ паспорт {n}", ("3",)), ("РОССИЙСКА ЛЕРАЦИЯ", ("2",)), ("ничего {n}", ("0",)), ("ПАСПОР гражданина", ("1",)), ("", ("0",))])
def keyword_scores(df: DataFrame) -> dict[str, Column]:
    """Printed words of a document in recognised texts, misread ones too."""
    return {"score": words.keyword_score(F.col("given"), ("РОССИЙСКАЯ", "ФЕДЕРАЦИЯ", "ПАСПОРТ"))}


@planted("customer", "c_custkey", ("first", "issued", "department", "n"), [
    ("4508 № 123456 выдан 01.02.2003 код 770-001; 2003 654321; 4508 123456", ("4508 123456", "01.02.2003", "770-001", "1")), ("нет {n}", (None, None, None, None)),
])
def earlier_documents(df: DataFrame) -> DataFrame:
    """Earlier documents listed on a page."""
    found = words.earlier_documents(df, ["c_custkey"], "given")
    at = lambda name: F.col("earlier")[0][name]
    return df.select("c_custkey").join(found, "c_custkey", "left").select("c_custkey", at("series_number").alias("first"), at("issue_date").alias("issued"), at("department_code").alias("department"), F.when(F.col("earlier").isNotNull(), F.size("earlier")).alias("n"))


# ---------------------------------------------------------------------------------------------------------------
# owners


@planted("customer", "c_custkey", ("surname", "number", "issued", "place", "city", "phone", "mail", "notes"), [
    ("ТЕСТОВ;4509 000000;ОВД г. Тестова 20.04.2010, код подразделения 770-001;101000, г. Тестов, ул. Новая, 1;8 999 000 00 00;A{n}@B.RU", ("Тестов", "4509000000", "20.04.2010", "ОВД г. Тестова", "Тестов", "+79990000000", "a{n}@b.ru", "2")),
    ("Тестов;12;;Москва, ул. Новая;123;", ("Тестов", "12", None, None, "Москва", "123", None, "2")), (";;;с. Новое, ул. Мира;;", (None, None, None, None, "Новое", None, None, "1")),
])
def owner_fill(df: DataFrame) -> DataFrame:
    """What is to be filled in for a new owner, and notes on what can't be."""
    keys = ("surname", "passport", "issued", "address", "phone", "email")
    form = F.create_map(*(x for i, k in enumerate(keys) for x in (F.lit(k), F.split_part("given", F.lit(";"), F.lit(i + 1)))))
    given, fill = df.select("c_custkey", form.alias("form")), F.col("found")
    got = lambda k: fill["fields"][k]
    columns = {"surname": got("person_r_surname"), "number": got("passport_number"), "issued": got("passport_date"), "place": got("passport_place"), "city": got("p_addr_city"), "phone": got("phone"), "mail": got("e_mail"), "notes": F.size(fill["notes"])}
    return _from_one(given, owners.prepare_fill(F.col("form")), columns)


@planted("customer", "c_custkey", ("owner", "saved"), [
    ("Тестов;8 999 000 00 00, 123;Тестов;+79990000000", ("ok,ok", "ok,ok")), ("Другой;123;Тестов;+79990000000", ("fail,fail", "fail,fail")), (";;Тестов;+79990000000", (",", "fail,fail")),
])
def owner_compare(df: DataFrame) -> dict[str, Column]:
    """An account's card against the application, and what was saved against what was to be."""
    part = [F.split_part("given", F.lit(";"), F.lit(i)) for i in (1, 2, 3, 4)]
    made = lambda a, b: F.create_map(F.lit("person_r_surname"), a, F.lit("phone"), b)
    rows = owners.compare_owner(made(part[0], part[1]), made(part[2], part[3]))
    own = F.filter(rows, lambda r: r["field"].isin("person_r_surname", "phone"))
    saved = owners.verify_saved(made(part[0], F.split_part(part[1], F.lit(","), F.lit(1))), made(part[2], part[3]))
    return {"owner": F.array_join(F.transform(own, lambda r: r["status"]), ","), "saved": F.array_join(F.transform(saved, lambda r: r["status"]), ",")}


# ---------------------------------------------------------------------------------------------------------------
# sections, stored answers, pages

SECTION_FORM = {
    "id": "transfer", "detect": {"keywords": ["заявление", "домен", "администратор"], "min_hits": 2, "title": ["заявление о смене администратора"], "continuation": ["новому администратору", "подпись заявителя"]}, "labels": ["ФИО", "подпись"],
    "fields": {
        "new_admin_fio": {"type": "fio_or_org", "text": [r"ФИО:\s*(.+?)\n"]}, "new_admin_org": {"type": "org", "text": [r"Организация:\s*(.+?)\n"]},
        "new_admin_contact": {"type": "contact", "text": [r"Контакт:\s*(.+?)\n"]}, "new_admin_org_contact": {"type": "contact", "text": [r"Контакт юрлица:\s*(.+?)\n"]},
    },
}
_BLOCK = {"start": ["(?i)новый владелец:"], "end": ["подпись$"], "max_lines": 14}


@planted("orders", "o_orderkey", ("person", "org", "contact", "org_contact"), [
    ("ФИО: подпись\nНовый владелец:\nООО «Ромашка»\nПробный Иван Ильич\na{n}@b.ru\nподпись", ("ПРОБНЫЙ ИВАН ИЛЬИЧ", "ООО «Ромашка»", "a{n}@b.ru", None)), ("ФИО: подпись\nКонтакт: нет\n", (None, None, None, None)),
    ("ФИО: Пробный Иван Ильич\nНовый владелец:\nДругой Иван Ильич\nb{n}@c.ru\nподпись", ("ПРОБНЫЙ ИВАН ИЛЬИЧ", None, "b{n}@c.ru", None)), ("Контакт юрлица: c{n}@d.ru\n", (None, None, "c{n}@d.ru", None)),
    ("Организация: ООО «Ромашка»\nКонтакт юрлица: c{n}@d.ru\n", (None, "ООО «Ромашка»", None, "c{n}@d.ru")),
])
def section_merge(df: DataFrame) -> DataFrame:
    """A section about a new owner merged into a form's fields: scraps go, gaps are filled, contacts without an owner move."""
    form = forms.load(SECTION_FORM)
    read = df.select("o_orderkey", forms.extract(F.col("given"), form).alias("read"), forms.section(F.col("given"), _BLOCK).alias("section"))
    read = read.select("o_orderkey", "read", forms.new_owner_section(F.col("section")).alias("new"))
    columns = {name: F.col("found")[role]["value"] for name, role in (("person", "new_admin_fio"), ("org", "new_admin_org"), ("contact", "new_admin_contact"), ("org_contact", "new_admin_org_contact"))}
    return _from_one(read, sections.merge_section(F.col("read"), F.col("new"), form), columns)


@planted("orders", "o_orderkey", ("found", "score", "start", "places", "reason"), [
    ("4018 304191 10 апреля 2019 года;паспорт 4018 304191 выдан кем-то 10 апреля 2019 года", ("4018 304191 10 апреля 2019 года", "95", "8", "", "no name")), ("ромашка ООО;фирма Ромашка ООО, адрес {n}", ("Ромашка ООО", "100", "6", "6", "no name")),
    ("Пробнй Иван Ильич;Я, Пробный Иван Ильич, прошу", ("Пробный Иван Ильич", "94", "3", "", None)), ("нет такого;фирма {n}", (None, "0", "-1", "", "no name")), ("Тестов П. … подпись;Тестов П. {n} подпись", ("Тестов П. подпись", "100", "0", "", None)),
    ("ФИО;ФИО фио", ("ФИО", "100", "0", "0|4", "label")),
])
def model_answers(df: DataFrame) -> DataFrame:
    """Stored answers of a model: where their quotes stand in the letter, how surely, how often, and why they can't be values."""
    q, s = F.split_part("given", F.lit(";"), F.lit(1)), F.split_part("given", F.lit(";"), F.lit(2))
    df, g = df.select("o_orderkey", q.alias("q"), s.alias("s")), F.col("found")
    columns = {"found": g["text"], "score": g["score"], "start": g["start"], "places": _listed(F.transform(answers.occurrences(F.col("q"), F.col("s")), lambda i: i.cast("string"))), "reason": answers.implausible("fio", F.col("q"), SECTION_FORM)}
    found = df.select("*", answers.ground(F.col("q"), F.col("s")).alias("found"))
    return found.select("o_orderkey", *(c.alias(n) for n, c in columns.items()))


@planted("pages", "page_id", ("inside", "extends", "printed", "named", "kept"), [
    ("a{n}.ru;в списке a{n}\n.ru;Виктор Дмитриевич Ан;Виктор Дмитриевич Андреев", ("true", "true", "false", "true", "ocr-text")), ("a{n}.ru;пишите x@a{n}.ru;Виктор;Виктор Андреев", ("false", "false", "false", "false", "llm-text")),
    ("ru;ru;и предоставляемых доменам администратору;и предоставляемых доменам администратору", ("false", "false", "true", "false", "ocr-text")),
])
def scan_evidence(df: DataFrame) -> dict[str, Column]:
    """What a page and its regions say of a field."""
    name, letter, page, region = (F.split_part("given", F.lit(";"), F.lit(i)) for i in (1, 2, 3, 4))
    source = F.when(F.col("page_id") % 3 == 1, "llm-text").otherwise("regex")
    return {
        "inside": answers.domain_in_text(name, letter), "extends": sections.region_extends(page, region), "printed": sections.only_form_words(region, ("предоставляемых", "доменам", "администратор")),
        "named": sections.title_names(F.concat(F.lit("Продление домена "), F.when(letter.contains("списке"), name).otherwise("z.ru")), F.array(name)), "kept": sections.kept_source(source),
    }


@planted("pages", "page_id", ("kind", "read_by", "note", "line"), [
    ("Заявление о смене администраторa\nдомен {n}, прошу сменить", ("start", "llm", None, "Заявление о смене администраторa")), ("1. a.ru\n2) b.ru\n3. пример.рф\nи ещё немного слов, чтобы текст был длинным", ("cont", "regex", "the model did not answer", None)), ("опись {n}", (None, "regex", None, None)),
    ("Новому администратору\nи подпись заявителя", ("cont", "regex", None, None)),
])
def pages_of_forms(df: DataFrame) -> DataFrame:
    """Which pages belong to a form, who reads them, and the line that stands at its head."""
    by = sections.read_by_model(F.col("given"), F.col("page_id") % 4 < 2, F.col("page_id") % 4 == 0)
    lines = df.select("page_id", F.posexplode(F.split("given", "\n")).alias("y0", "text"))
    head = sections.first_line_like(lines, ["page_id"], ["заявление о смене администратора"])
    return df.select("page_id", sections.page_kind(F.col("given"), SECTION_FORM).alias("kind"), by["by"].alias("read_by"), by["note"].alias("note")).join(head, "page_id", "left")
