"""Forms, checks, verdicts, domain lists, owners, sources and streams on invented cases."""

from __future__ import annotations

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from caseframe.operators import words
from caseframe.plans import checks, domains, forms, outputs, owners, rules, validate
from caseframe.sources import html, registries
from caseframe.streaming import edits

FORM = forms.load(
    {
        "id": "transfer",
        "detect": {"keywords": ["заявление", "домен", "администратор"], "min_hits": 2},
        "labels": ["ФИО", "подпись"],
        "fields": {
            "applicant_header": {"type": "fio_date", "text": [r"(?s)\bот\s+(.+?)\n"]},
            "passport": {"type": "passport", "text": [r"(?i)паспорт\s*:?\s*(.+?)\n"]},
            "inn": {"type": "inn", "text": [r"ИНН\s+(.+?)\n"]},
            "issued_by": {"type": "issuer", "text": [r"(?i)кем выдан\s*:?\s*(.+?)\n"]},
            "domains": {"type": "domains", "text": [r"(?s)домены:\s*(.+?)\nНовый"]},
            "new_admin_fio": {"type": "fio_or_org", "text": [r"Новый администратор:\s*(.+?)\n"]},
            "new_admin_contact": {"type": "contact", "text": [r"Контакт:\s*(.+?)\n"]},
            "application_date": {"type": "date_words", "text": [r"Дата:\s*(.+?)\n"]},
        },
    }
)
TEXT = (
    "ЗАЯВЛЕНИЕ администратора\nот Тестова Петра Сергеевича, 15.03.1990 г.р.\nПаспорт: 4509 000000, дата выдачи 20.04.2010\nИНН 990000000115\n"
    "Кем выдан: ОВД города Тестова\nдомены: info-\nstore.ru, test.рф\nНовый администратор: Пробный Иван Ильич\nКонтакт: a@b.ru, 8 (999) 000-00-00\nДата: седьмое августа две тысячи двадцатого года\n"
)


@pytest.fixture(scope="module")
def fields(spark):
    return forms.extract_documents(spark.createDataFrame([("c", TEXT)], "case_id string, body string"), FORM, "case_id", "body").first().fields


def test_form_fields(fields):
    assert fields["applicant_header"].value == "ТЕСТОВ ПЕТР СЕРГЕЕВИЧ" and fields["applicant_header.birth_date"].value == "15.03.1990"
    assert fields["passport"].value == "4509 000000" and fields["passport.issue_date"].value == "20.04.2010"
    assert fields["inn"].value == "990000000115" and fields["issued_by"].value == "ОВД города Тестова"
    assert fields["domains.list"].list == ["info-store.ru", "test.рф"]
    assert fields["new_admin_contact.emails"].list == ["a@b.ru"] and fields["new_admin_contact.phones"].list == ["89990000000"]
    assert fields["application_date"].value == "07.08.2020" and fields["application_date"].confidence == 0.98


def test_form_detection(spark):
    other = forms.load({"id": "other", "detect": {"keywords": ["счёт", "оплата"]}, "fields": {}})
    rows = spark.createDataFrame([(TEXT,), ("счёт и оплата",), ("ничего",)], "t string")
    assert [r.f for r in rows.select(forms.detect(F.col("t"), [FORM, other]).alias("f")).collect()] == ["transfer", "other", None]


def field(value, source="text", confidence=0.98, **more):
    return {"value": value, "list": None, "int_value": None, "confidence": confidence, "source": source, "raw": value, "needs_review": False, "crop": None, "alternatives": []} | more


PASSPORT = {"surname": "ТЕСТОВ", "given_name": "ПЁТР", "patronymic": "СЕРГЕЕВИЧ", "birth_date": "15.03.1990", "series_number": "4509 000000", "issue_date": "20.04.2010", "issued_by": "ОВД ГОРОДА ТЕСТОВА", "department_code": "770-001"}
TYPES = {
    "change": {
        "form": "transfer",
        "rules": {
            "reject": [{"when": {"flag": "old_passport"}, "reason": "old"}, {"when": {"check": "Серия и номер паспорта"}, "reason": "number"}, {"when": {"flag": "admin_mismatch"}, "reason": "owner"}],
            "review": [{"when": {"check": "Паспорт приложен", "status": "review"}, "reason": "no passport"}, {"when": {"any_status": ["review"]}, "reason": "look"}, {"when": {"any_status": ["warn", "fail"]}, "reason": "remarks"}],
        },
    },
    "off": {"enabled": False},
}


def case(fields, case_id="c", **changes):
    app = {k: (v.asDict() if hasattr(v, "asDict") else v) for k, v in fields.items()}
    row = {"case_id": case_id, "case_type": "change", "as_of": date(2021, 1, 1), "app": app, "pas": {k: field(v) for k, v in PASSPORT.items()}, "previous": [], "admin": None, "zone": None, "confirmed": [], "domain_checks": None, "domain_flags": None}
    return row | changes


def evaluated(spark, rows):
    return {r.case_id: r for r in checks.evaluate(spark.createDataFrame(rows, checks.CASE), TYPES).collect()}


def test_cases_are_decided(spark, fields):
    good = case(fields)
    wrong = case(fields, "wrong", pas=good["pas"] | {"series_number": field("4509 000001")})
    unsure = case(fields, "unsure", pas=good["pas"] | {"series_number": field("4509 000001", "vlm")})
    absent = case(fields, "absent", pas=None)
    old = case(fields, "old", pas=good["pas"] | {"series_number": field("4510 111111")}, previous=[{"series_number": "4509 000000", "department_code": None, "issue_date": None, "page": 1}])
    owner = case(fields, "owner", admin={"fio": "Другой Человек Иванович", "birth_date": "", "passport": "", "passport_issue_date": "", "passport_issued_by": "", "domains": ["else.ru"], "source": "x"})
    off = case(fields, "off", case_type="off")
    got = evaluated(spark, [good, wrong, unsure, absent, old, owner, off])
    status = lambda k: {c.name: c.status for c in got[k].checks}
    assert set(got) == {"c", "wrong", "unsure", "absent", "old", "owner"}
    assert status("c")["ФИО в шапке («от …»)"] == "ok" and status("c")["Серия и номер паспорта"] == "ok" and status("c")["ИНН ИП: контрольные цифры"] == "ok"
    assert status("wrong")["Серия и номер паспорта"] == "fail" and (got["wrong"].decision.code, got["wrong"].decision.reasons[-1]) == ("reject", "number")
    assert status("unsure")["Серия и номер паспорта"] == "review" and got["unsure"].decision.code in ("review", "reject")
    assert got["absent"].decision.code == "review" and got["absent"].decision.reasons[0] == "no passport"
    assert got["old"].flags == ["old_passport"] and got["old"].decision.reasons[0] == "old"
    assert got["owner"].flags == ["admin_mismatch"] and got["owner"].decision.code == "reject"
    alone = evaluated(spark, [wrong])["wrong"]  # a batch changes nothing of a case
    assert alone.checks == got["wrong"].checks and alone.decision == got["wrong"].decision


def test_confirmation_only_lifts_reviews_and_warnings(spark, fields):
    app = dict(fields) | {"contract": field("??", "vlm")}
    got = evaluated(spark, [case(app, "a"), case(app, "b", confirmed=["contract"])])
    name = "Договор/аккаунт нового администратора"
    assert [next(c.status for c in got[k].checks if c.name == name) for k in "ab"] == ["review", "ok"]


def test_rules_reject_before_review(spark):
    c = F.array(rules.check("n", "fail"), rules.check("m", "review"))
    r = {"reject": [{"when": {"check": "n"}, "reason": "x"}, {"when": {"check": "n"}, "reason": "x"}], "review": [{"when": {"any_status": "review"}, "reason": "y"}]}
    none = F.array().cast("array<string>")
    row = spark.range(1).select(rules.decide(r, c, none).alias("a"), rules.decide({"review": r["review"]}, c, none).alias("b"), rules.decide({}, c, none).alias("c")).first()
    assert [(x.code, x.reasons) for x in row] == [("reject", ["x"]), ("review", ["y"]), ("accept", [])]
    with pytest.raises(ValueError):
        rules.condition({}, c, none)


def test_domain_lists(spark, fields):
    ref = domains.reference(spark.createDataFrame([case(fields)], checks.CASE))
    assert ref.first().reference.passport == "4509 000000"
    sd = {"person_r_surname": "Тестов", "person_r_name": "Пётр", "person_r_patronimic": "Сергеевич", "birth_date": "1990-03-15", "passport_series": "4509", "passport_number_short": "000000"}
    rows = [
        ("c", 0, "a.ru", "found", "person", "ru_pp", sd, "", None, "1"), ("c", 1, "b.ru", "found", "person", "ru_pp", sd | {"person_r_surname": "Другой", "birth_date": "1980-01-01", "passport_number_short": "000001"}, "да", None, "1"),
        ("c", 2, "a-1.ru", "not_found", "", "", {}, "", "free", ""), ("c", 3, "d.ru", "error", "", "", {}, "", None, ""),
    ]
    lookups = spark.createDataFrame(rows, "case_id string, pos int, domain string, status string, kind string, grp string, sd map<string,string>, trustee string, registry string, account string")
    compared = domains.compare(lookups.join(ref, "case_id")).cache()
    assert {r.domain: (r.verdict, r.problem) for r in compared.collect()} == {"a.ru": ("ok", "ok"), "b.ru": ("fail", "mismatch"), "a-1.ru": ("", "free"), "d.ru": ("", "error")}
    s = domains.summarise(compared).first()
    assert [c.status for c in s.domain_checks][:2] == ["fail", "fail"] and s.domain_flags == ["admin_mismatch"]
    assert domains.owner_groups(compared).count() == 2 and domains.accounts_with_several_owners(compared).first().owners == 2
    assert [(r.domain, r.known) for r in domains.similar_known(compared, 0.6).collect()] == [("a-1.ru", "a.ru")]


def test_identity_comparison(spark):
    record = json.dumps({"last_name": "ТЕСТОВ", "first_name": "ПЁТР", "birth_date": "15.03.1990", "citizenship": "RUS", "rf_passport": {"series": "4509", "number": "000009"}, "secret": "x"})
    sd = {"person_r_surname": "Тестов", "person_r_name": "Петр", "birth_date": "1990-03-15", "country": "RU", "passport_series": "4509", "passport_number_short": "000000"}
    frame = spark.createDataFrame([(record, "person", sd)], "record string, kind string, sd map<string,string>")
    r = frame.select(domains.compare_identity(F.col("record"), F.col("kind"), {"RUS": "RU"}).alias("c")).first().c
    assert {x.field: x.status for x in r if x.status} == {"person_r_surname": "ok", "person_r_name": "ok", "birth_date": "ok", "country": "ok", "passport_series": "ok", "passport_number_short": "fail"}


def test_owners(spark):
    form = {"surname": "ТЕСТОВ", "name": "пётр", "patronymic": "", "passport": "4509 000000", "issued": "ОВД г. Тестова 20.04.2010, код подразделения 770-001", "address": "101000, г. Тестов, ул. Новая, 1", "phone": "8 999 000 00 00", "email": "A@B.RU"}
    r = spark.createDataFrame([(form,)], "f map<string,string>").select(owners.prepare_fill(F.col("f")).alias("p")).first().p
    assert r.fields["person_r_surname"] == "Тестов" and r.fields["passport_number"] == "4509000000" and r.fields["passport_date"] == "20.04.2010"
    assert r.fields["p_addr_city"] == "Тестов" and r.fields["phone"] == "+79990000000" and r.fields["e_mail"] == "a@b.ru" and "no postal code" in r.notes
    saved = spark.createDataFrame([({"phone": "89990000000", "e_mail": ""}, {"phone": "+79990000000", "e_mail": "a@b.ru"})], "s map<string,string>, e map<string,string>")
    assert [x.status for x in saved.select(owners.verify_saved(F.col("s"), F.col("e")).alias("v")).first().v] == ["ok", "fail"]


def test_registry_replies(spark):
    whois = "% comment\ndomain: TEST.RU\nstate: REGISTERED, DELEGATED\nregistrar: R-RU\ncreated: 2020-01-01\npaid-till: 2030-01-01\n"
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    r = one(registries.parse_whois(F.lit(whois)))
    assert (r.status, r.registrar, r.created, r.paid_till) == ("registered", "R-RU", "2020-01-01", "2030-01-01")
    assert one(registries.parse_whois(F.lit("No entries found for x.ru"))).status == "free" and one(registries.parse_whois(F.lit("???"))).status == "error"
    rdap = json.dumps({"ldhName": "test.com", "status": ["active"], "events": [{"eventAction": "registration", "eventDate": "2020"}, {"eventAction": "expiration", "eventDate": "2030"}], "entities": [{"roles": ["registrar"], "vcardArray": ["vcard", [["fn", {}, "text", "Some Registrar"]]]}]})
    r = one(registries.parse_rdap(F.lit(rdap), F.lit(200)))
    assert (r.status, r.registrar, r.created, r.paid_till) == ("registered", "Some Registrar", "2020", "2030") and one(registries.parse_rdap(F.lit(""), F.lit(404))).status == "free"
    kinds = {"user_id=123": ("id", "123"), "a@b.ru": ("login", "a@b.ru"), "https://Test.ru/x": ("domain", "test.ru"), "some_login": ("login", "some_login"), "": ("", "")}
    assert {k: (v.kind, v.value) for k in kinds for v in [one(registries.query_kind(F.lit(k)))]} == kinds


def test_html(spark):
    page = "<title>T</title><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr><tr><td>x</td></tr></table><table><tr><td>Login:</td><td>me</td></tr></table><table><tr><td>g</td><td>f</td><td>v</td></tr><tr><td>g</td><td>secret</td><td>s</td></tr></table><input name=a value=1><a href='/u'>l</a>"
    parts = html.page_parts(spark.createDataFrame([(1, page), (2, None)], "id long, html string"), "id", "html").cache()
    assert [r.record for r in html.header_records(parts, "id", ("A", "B")).collect()] == [{"A": "1", "B": "2"}]
    assert {r.name: r.value for r in html.label_values(parts, "id", ("Login",)).collect()} == {"Login": "me"}
    assert html.group_fields(parts, "id", ("f",)).first().fields == {"f": "v"} and html.inputs(parts, "id", ("a",)).first().inputs == {"a": "1"}


def test_recognised_words(spark):
    rows = [("p", 1, 1, 1, i, t, c, x, y, 10, 10) for i, (t, c, x, y) in enumerate([("a", 90.0, 0, 0), ("b", 80.0, 20, 0), (" ", 90.0, 40, 0)])] + [("p", 1, 1, 2, 0, "c", 70.0, 0, 30, 10, 10), ("p", 1, 1, 2, 1, "d", -1.0, 0, 30, 10, 10)]
    w = spark.createDataFrame(rows, "page string, block int, par int, line int, word int, text string, conf double, x int, y int, w int, h int")
    lines = words.lines_of(w, ["page"])
    assert {r.text: r.conf for r in lines.collect()} == {"a b": 85.0, "c": 70.0} and words.page_text(lines, ["page"]).first().text == "a b\nc"
    ys = spark.createDataFrame([("p", 0.0, "a"), ("p", 0.01, "b"), ("p", 0.02, "c")], "page string, y double, text string")
    assert [[x.text for x in row] for row in words.rows_by_first(ys, ["page"], "y", 0.012).first().rows] == [["a", "b"], ["c"]]
    pages = spark.createDataFrame([("c", "4508 № 123456 выдан 01.02.2003 код 770-001; 2003 654321; 4508 123456")], "case_id string, body string")
    assert [(e.series_number, e.issue_date, e.department_code) for e in words.earlier_documents(pages, ["case_id"], "body").first().earlier] == [("4508 123456", "01.02.2003", "770-001")]


def test_streams(spark, tmp_path):
    schema = "case_id string, role string, value string, at timestamp"
    for i, rows in enumerate(([("a", "x", "1", datetime(2020, 1, 1))], [("a", "x", "2", datetime(2020, 1, 2)), ("b", "x", "3", datetime(2020, 1, 1))])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = edits.submissions(spark, f"{tmp_path}/in/*", schema)
    latest = edits.run_to_memory(edits.latest_values(stream, ["case_id", "role"], "value", "at"), "latest_edits", "complete")
    assert {r.case_id: (r.value, r.edits) for r in latest.collect()} == {"a": ("2", 2), "b": ("3", 1)}
    for _ in range(2):  # a restart adds nothing
        edits.evaluate_each(edits.submissions(spark, f"{tmp_path}/in/*", schema), lambda b: b, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_outputs_are_written_by_day_and_can_be_repeated(spark, fields, tmp_path):
    good = case(fields, confirmed=["contract"])
    known = {"fio": "Тестов Пётр Сергеевич", "birth_date": "", "passport": "4508 111111", "passport_issue_date": "01.01.2008", "passport_issued_by": "овд города тестова", "domains": [], "source": "x"}
    rows = [good, case(fields, "later", as_of=date(2021, 1, 2), admin=known), case(fields, "alone", pas=None, app={"applicant_fio": field("Тестова Петра Сергеевича")})]
    cases = spark.createDataFrame(rows, checks.CASE)
    whole = cases.drop("case_type").join(checks.evaluate(cases, TYPES), "case_id")
    for _ in range(2):
        outputs.save_outputs(whole, str(tmp_path))
    exported = {r.case_id: r for r in spark.read.json(f"{tmp_path}/export").collect()}
    assert set(exported) == {"c", "later", "alone"} and spark.read.parquet(f"{tmp_path}/register").count() == 3 and spark.read.json(f"{tmp_path}/result").count() == 3
    one = exported["c"]
    assert (one.applicant.surname, one.applicant.given_name, one.applicant.passport.series, one.applicant.passport.number) == ("Тестов", "Петр", "4509", "000000")
    assert [d.name for d in one.domains] == ["info-store.ru", "test.рф"] and one.domains[1].punycode.startswith("test.xn--") and one.new_admin.emails == ["a@b.ru"] and one.confirmed_by_operator == ["contract"]
    assert exported["alone"].applicant.surname == "Тестов" and exported["alone"].applicant.passport.series == ""
    update = exported["later"].system_update
    assert (update.passport.before, update.passport.after) == ("4508 111111", "4509 000000") and update.passport_issue_date.after == "20.04.2010" and "passport_issued_by" not in update.asDict()


def test_configuration_problems():
    assert validate.problems([FORM], {"change": TYPES["change"], "off": {"enabled": False}}) == []
    bad = {"id": "bad", "detect": {}, "fields": {"a": {"type": "nothing", "text": ["(", "x"], "role": "r", "digits": [0]}, "b": {"role": "r", "llm": False}, "c": {"scan": {"region": {"x0": 0}}}}, "rows": [{"id": "fio"}]}
    types = {"t": {"form": "none", "checks": ["nothing"], "rules": {"reject": [{"when": {"flag": "zz"}, "reason": "q"}, {"when": {"check": "Дата рождения", "status": ["odd"]}, "reason": "w"}]}}, "empty": {}}
    found = "\n".join(validate.problems([bad, bad | {"rows": []}], types, ["fio", "passport"]))
    for part in ("used 2 times", "no keywords", "unknown type 'nothing'", "is no pattern", "has no group", "several fields", "digits is", "nothing reads it", "without an anchor", "lacks dy0, dy1, x1", "needs id and title", "its id is taken", "no form 'none'", "unknown check 'nothing'", "nothing raises the flag 'zz'", "not among the type's checks", "unknown status 'odd'", "must list its checks", "no row 'address'"):
        assert part in found, part


def test_configuration_files(tmp_path):
    (tmp_path / "a.yaml").write_text("id: a\ndetect: {keywords: [x]}\nfields:\n  inn: {type: inn, text: ['ИНН (.+)']}\n", encoding="utf-8")
    (tmp_path / "types.yml").write_text("t: {form: a}\n", encoding="utf-8")
    found = validate.load_forms(tmp_path)
    assert [f["id"] for f in found] == ["a"] and found[0]["fields"]["inn"]["role"] == "inn"
    assert validate.problems(found, validate.load_case_types(tmp_path / "types.yml")) == []


def test_owner_record_of_the_first_name_that_has_one(spark):
    records = spark.createDataFrame([("b.ru", "B"), ("c.ru", "C")], "domain string, record string")
    asked = spark.createDataFrame([("x", 0, "a.ru"), ("x", 1, "c.ru"), ("x", 2, "b.ru"), ("y", 0, "a.ru")], "case_id string, pos int, domain string")
    assert [(r.case_id, r.domain, r.record) for r in registries.owner_records(records, asked).collect()] == [("x", "c.ru", "C")]
    stored, missing = registries.cached_answers(spark.createDataFrame([("p",), ("q",)], "payload string"), spark.createDataFrame([("p", "1"), ("p", "1")], "payload string, answer string").selectExpr("sha2(payload, 256) AS digest", "answer"))
    assert [(r.payload, r.answer) for r in stored.collect()] == [("p", "1")] and [r.payload for r in missing.collect()] == ["q"]


def test_documents_from_several_readings(spark):
    made = [("c", "surname", "ocr", field("ТЕСТОВ")), ("c", "surname", "mrz", field("ТЕСТОВА")), ("c", "birth_date", "ocr", field("01.01.2020")), ("c", "issue_date", "manual", field("01.01.1990", "manual"))]
    kind = f"case_id string, role string, source string, field {checks.FIELD}"
    chosen = words.choose_source(spark.createDataFrame(made, kind), ["case_id"], ["mrz", "ocr", "manual"])
    roles = words.implausible_dates(F.col("fields"), date(2021, 1, 1))
    r = chosen.select("fields", roles.alias("bad"), words.set_aside(F.col("fields"), roles).alias("left")).first()
    assert r.fields["surname"].value == "ТЕСТОВА" and r.fields["surname"].alternatives == ["ТЕСТОВ"] and r.bad == ["birth_date"]
    assert r.left["birth_date"].value is None and r.left["birth_date"].alternatives[0] == "01.01.2020" and r.left["issue_date"].value == "01.01.1990"


def test_requests_once_each(spark, tmp_path):
    spark.createDataFrame([("a", datetime(2020, 1, 1, 0, 0)), ("a", datetime(2020, 1, 1, 0, 1)), ("b", datetime(2020, 1, 1, 0, 2))], "url string, at timestamp").write.parquet(f"{tmp_path}/in")
    stream = edits.submissions(spark, f"{tmp_path}/in", "url string, at timestamp")
    assert sorted(r.url for r in edits.run_to_memory(edits.once_each(stream, ["url"], "at", "10 minutes"), "once_each").collect()) == ["a", "b"]
