"""Whole cases over the driver's orders: each order is an application of one of a few kinds, checked and decided, and the SQL states
what has to come out of each kind. Domain lists and streams over the same tables stand beside them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseframe.operators import grouping
from caseframe.plans import checks
from caseframe.plans import domains as domain_plan
from caseframe.plans import outputs
from caseframe.queries import ORACLE_SQL, QUERIES, spread, table
from caseframe.streaming import edits, lookups


def field(value: str | None = None, confidence: float = 0.98, source: str = "text", crop: str | None = None, alternatives: Sequence[str] = (), items: Sequence[str] | None = None, number: int | None = None) -> dict:
    return {"value": value, "list": None if items is None else list(items), "int_value": number, "confidence": confidence, "source": source, "raw": value, "needs_review": False, "crop": crop, "alternatives": list(alternatives)}


_UNSURE, _CROP = {"confidence": 0.4}, {"crop": "c.png"}
NAME = {"surname": "ТЕСТОВ", "given_name": "ПЕТР", "patronymic": "СЕРГЕЕВИЧ"}
_SAME, _OTHER = "Тестова Петра Сергеевича", "Жук Фома Ильич"


def case(app: Mapping, read: Mapping | None, **more) -> dict:
    row = {"as_of": date(2021, 1, 1), "app": dict(app), "pas": None if read is None else {k: v if isinstance(v, dict) else field(v) for k, v in read.items()}, "previous": [], "admin": None, "zone": None, "confirmed": [], "domain_checks": None, "domain_flags": None}
    return row | more


def _admin(fio: str, passport: str = "", issued_by: str = "", names: Sequence[str] = (), born: str = "") -> dict:
    return {"fio": fio, "birth_date": born, "passport": passport, "passport_issue_date": "", "passport_issued_by": issued_by, "domains": list(names), "source": "x"}


#: (checks of the case type, [(case, [(name of the check, status)], flags)]) for each family.
FAMILIES: dict[str, tuple[tuple[str, ...], list]] = {
    "names": (
        ("fio_header", "fio_text", "fio_signature", "fio_header_vs_text"),
        [
            (case({"applicant_header": field(_SAME), "applicant_fio": field(_SAME), "signature_fio": field(_OTHER)}, NAME), [("ФИО в шапке («от …»)", "ok"), ("ФИО в тексте («Я, …»)", "ok"), ("ФИО у подписи", "fail")], []),
            (case({"applicant_header": field(None, **_CROP), "applicant_fio": field(_OTHER, **_UNSURE)}, NAME), [("ФИО в шапке («от …»)", "review"), ("ФИО в тексте («Я, …»)", "review")], []),
            (case({"applicant_header": field(_SAME)}, {"surname": ""}), [("ФИО в шапке («от …»)", "review"), ("ФИО в тексте («Я, …»)", "review")], []),
            (case({"applicant_header": field(_SAME), "applicant_fio": field(_OTHER)}, None), [("ФИО: шапка ↔ «Я, …»", "fail")], []),
            (case({"applicant_header": field(_SAME, source="рукопись"), "applicant_fio": field(_OTHER)}, None), [("ФИО: шапка ↔ «Я, …»", "review")], []),
        ],
    ),
    "values": (
        ("birth_date", "passport_number", "passport_issue_date", "series_year", "passport_loaded", "address"),
        [
            (case({"applicant_header.birth_date": field("15.03.1990"), "passport": field("45 10 000000"), "passport.issue_date": field("20.04.2010"), "address": field("г. Тестов")}, {"birth_date": "15.03.1990", "series_number": "4510 000000", "issue_date": "20.04.2010"}), [("Дата рождения", "ok"), ("Серия и номер паспорта", "ok"), ("Дата выдачи паспорта", "ok"), ("Адрес регистрации", "info")], []),
            (case({"applicant_header.birth_date": field("16.03.1990"), "passport": field("4512 000001"), "passport.issue_date": field("20.04.2010")}, {"birth_date": "15.03.1990", "series_number": field("4512 000000", alternatives=["4512 000001"]), "issue_date": field("21.04.2010", **_UNSURE)}), [("Дата рождения", "fail"), ("Серия и номер паспорта", "ok"), ("Дата выдачи паспорта", "review"), ("Серия ↔ год выдачи", "warn"), ("Адрес регистрации", "info")], []),
            (case({"applicant_header": field(None, **_CROP), "passport.issue_date": field("20.04.2010")}, {"birth_date": "15.03.1990", "series_number": "4511 000000"}), [("Дата рождения", "review"), ("Серия и номер паспорта", "warn"), ("Дата выдачи паспорта", "review"), ("Серия ↔ год выдачи", "info"), ("Адрес регистрации", "info")], []),
            (case({"passport": field("4510 000000")}, None), [("Паспорт приложен", "review")], []),
        ],
    ),
    "issuers": (
        ("issued_by", "issuer_region", "mrz"),
        [
            (case({"issued_by": field("ОВД г. Тестова")}, {"issued_by": "ОТДЕЛ ВНУТРЕННИХ ДЕЛ ГОРОДА ТЕСТОВА", "department_code": "010-001"}, zone={"valid": True, "raw": "P<", "failed": []}), [("Кем выдан", "ok"), ("Кем выдан ↔ код подразделения", "ok"), ("MRZ паспорта", "ok")], []),
            (case({"issued_by": field("ТП № 5")}, {"issued_by": "ОВД ГОРОДА ТЕСТОВА", "department_code": "020-001"}, zone={"valid": False, "raw": "P<", "failed": ["number"]}), [("Кем выдан", "fail"), ("Кем выдан ↔ код подразделения", "warn"), ("MRZ паспорта", "warn")], []),
            (case({"issued_by": field("ТП № 5")}, {"issued_by": field("ОВД ГОРОДА ТЕСТОВА", **_UNSURE), "department_code": "020-001"}), [("Кем выдан", "review"), ("Кем выдан ↔ код подразделения", "review")], []),
            (case({}, {"issued_by": "ОВД ГОРОДА ТЕСТОВА", "department_code": "990-001"}), [("Кем выдан", "ok"), ("Кем выдан ↔ код подразделения", "info")], []),
            (case({}, {"issued_by": "НИЧЕГО"}), [("Кем выдан", "review")], []),
        ],
    ),
    "applications": (
        ("inn", "domains", "new_admin", "new_admin_text_vs_table", "new_admin_not_applicant", "new_admin_contact", "contract", "application_date"),
        [
            (case({"inn": field("990000000115"), "domains.list": field(items=["a.ru"]), "domains.stated_count": field(number=1), "new_admin_fio": field("Пробный Иван Ильич"), "new_admin_contact": field("a@b.ru"), "contract": field("договор 12345"), "application_date": field("20.12.2020")}, NAME),
             [("ИНН ИП: контрольные цифры", "ok"), ("Домен(ы)", "ok"), ("Новый администратор указан", "ok"), ("Контакты нового администратора", "ok"), ("Договор/аккаунт нового администратора", "ok"), ("Дата заявления", "ok")], []),
            (case({"inn": field("990000000116"), "domains.list": field(items=["a.ru"]), "domains.stated_count": field(number=2), "new_admin_fio": field(_SAME), "new_admin_inline": field("Другой Иван Ильич"), "contract": field("??"), "application_date": field("20.12.2022")}, NAME),
             [("ИНН ИП: контрольные цифры", "fail"), ("Домен(ы)", "review"), ("Новый администратор указан", "ok"), ("Новый администратор: текст ↔ таблица", "warn"), ("Новый администратор ≠ заявитель", "fail"), ("Контакты нового администратора", "warn"), ("Договор/аккаунт нового администратора", "review"), ("Дата заявления", "fail")], []),
            (case({"domains": field(None, **_CROP), "new_admin_fio": field(None, **_CROP), "application_date": field("не видно", **_CROP)}, None),
             [("Домен(ы)", "review"), ("Новый администратор указан", "review"), ("Контакты нового администратора", "warn"), ("Договор/аккаунт нового администратора", "warn"), ("Дата заявления", "review")], []),
            (case({"domains.list": field(items=["a_b"])}, None), [("Домен(ы)", "fail"), ("Новый администратор указан", "fail"), ("Контакты нового администратора", "warn"), ("Договор/аккаунт нового администратора", "warn"), ("Дата заявления", "warn")], []),
        ],
    ),
    "owners": (
        ("old_passport", "system_admin"),
        [
            (case({"passport": field("4509 000000"), "domains.list": field(items=["a.ru"])}, NAME | {"series_number": "4510 111111"}, previous=[{"series_number": "4509 000000", "department_code": None, "issue_date": None, "page": 1}]), [("Указан прежний паспорт", "fail")], ["old_passport"]),
            (case({"domains.list": field(items=["a.ru", "z.ru"])}, NAME | {"series_number": "4510 111111", "issued_by": "ОВД"}, admin=_admin("Тестов Петр Сергеевич", "4509 000000", names=["a.ru"])), [("Заявитель — текущий администратор", "ok"), ("Паспорт в системе устарел", "info"), ("Домены администратора", "fail")], ["admin_mismatch"]),
            (case({}, NAME | {"series_number": "4510 111111"}, admin=_admin(_OTHER)), [("Заявитель — текущий администратор", "fail")], ["admin_mismatch"]),
            (case({"applicant_fio": field(_SAME), "passport": field("4509 000000"), "passport.issue_date": field("20.04.2009")}, NAME | {"series_number": field("4510 111111", **_UNSURE), "issue_date": "20.04.2010", "issued_by": "ОВД"}, admin=_admin("Тестов Петр Сергеевич", "4510 111111", "ОВД")), [("Указан прежний паспорт", "review"), ("Заявитель — текущий администратор", "ok"), ("Кем выдан ↔ данные системы", "ok")], []),
            (case({}, NAME), [], []),
        ],
    ),
}
#: What a case's checks come to.
CASE_RULES = {
    "reject": [{"when": {"flag": "old_passport"}, "reason": "old document"}, {"when": {"flag": "admin_mismatch"}, "reason": "other owner"}],
    "review": [{"when": {"any_status": ["fail", "review"]}, "reason": "look"}, {"when": {"any_status": ["warn"]}, "reason": "remarks"}],
}
SETTINGS = checks.Settings(region_stems={"01": ("ТЕСТОВ",), "02": ("УВД$",)})


def _kinds(spark: SparkSession) -> DataFrame:
    """Each kind of case once: a dimension of as many rows as are written above."""
    rows = [{"case_id": f"{family}:{i}", "case_type": family} | c for family, (_, cases) in FAMILIES.items() for i, (c, _, _) in enumerate(cases)]
    return spark.createDataFrame(rows, checks.CASE)


def cases(spark: SparkSession, sf: str, family: str) -> DataFrame:
    """Every order as a case of a family, of a kind by its number."""
    n = len(FAMILIES[family][1])
    kinds = _kinds(spark).where(F.col("case_type") == family).withColumn("kind", F.split_part("case_id", F.lit(":"), F.lit(2)).cast("int")).drop("case_id")
    orders = spread(table(spark, sf, "orders").select("o_orderkey")).select(F.col("o_orderkey").cast("string").alias("case_id"), (F.col("o_orderkey") % n).cast("int").alias("kind"))
    return orders.join(F.broadcast(kinds), "kind").drop("kind")


def evaluated(spark: SparkSession, sf: str, family: str, carried: Sequence[str] = ()) -> DataFrame:
    return checks.evaluate(cases(spark, sf, family), {family: {"form": "x", "checks": FAMILIES[family][0], "rules": CASE_RULES}}, SETTINGS, carried)


def _decision(found: Sequence[tuple[str, str]], flags: Sequence[str]) -> tuple[str, str]:
    """The rules above, worked out by hand."""
    statuses = {s for _, s in found}
    reasons = [r for f, r in (("old_passport", "old document"), ("admin_mismatch", "other owner")) if f in flags]
    if reasons:
        return "reject", "; ".join(reasons)
    reasons = [r for wanted, r in (({"fail", "review"}, "look"), ({"warn"}, "remarks")) if statuses & wanted]
    return ("review", "; ".join(reasons)) if reasons else ("accept", "")


def _values(rows: Sequence[Sequence[object]]) -> str:
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'" for v in r) + ")" for r in rows)


def _register(family: str) -> None:
    kinds = FAMILIES[family][1]

    def listed(spark: SparkSession, sf: str) -> DataFrame:
        return checks.check_table(evaluated(spark, sf, family)).select(F.col("case_id").cast("long").alias("case_id"), F.col("name").alias("check_name"), "status")

    def decided(spark: SparkSession, sf: str) -> DataFrame:
        worst = grouping.worst(F.transform("checks", lambda c: c["status"]))
        return evaluated(spark, sf, family).select(F.col("case_id").cast("long").alias("case_id"), F.col("decision.code").alias("code"), F.concat_ws("; ", "decision.reasons").alias("reasons"), F.concat_ws(",", "flags").alias("flags"), worst.alias("worst"))

    rank = dict(grouping.SEVERITY)
    found = [(i, name, status) for i, (_, own, _) in enumerate(kinds) for name, status in own]
    ends = [(i, *_decision(own, flags), ",".join(flags), max((s for _, s in own), key=rank.__getitem__, default="")) for i, (_, own, flags) in enumerate(kinds)]
    listed.__name__, decided.__name__ = f"checks_of_{family}", f"decisions_of_{family}"
    listed.__doc__ = f"The checks of {family}, a row for each check of each order's case."
    decided.__doc__ = f"Decision, flags and worst status of each order's case of {family}."
    QUERIES[listed.__name__], QUERIES[decided.__name__] = listed, decided
    ORACLE_SQL[listed.__name__] = f"SELECT o_orderkey AS case_id, check_name, status FROM orders JOIN (VALUES {_values(found)}) AS k(kind, check_name, status) ON o_orderkey % {len(kinds)} = kind"
    ORACLE_SQL[decided.__name__] = f"SELECT o_orderkey AS case_id, code, reasons, flags, worst FROM orders JOIN (VALUES {_values(ends)}) AS k(kind, code, reasons, flags, worst) ON o_orderkey % {len(kinds)} = kind"


for _family in FAMILIES:
    _register(_family)


# ---------------------------------------------------------------------------------------------------------------
# a case's list of names: an order's line items are its names, a supplier's record who owns each

_SD = {"person_r_surname": "Тестов", "person_r_name": "Пётр", "person_r_patronimic": "Сергеевич", "birth_date": "1990-03-15", "passport_series": "4509", "passport_number_short": "000000"}


def _lookups(spark: SparkSession, sf: str) -> DataFrame:
    """A reply for each line item: found (as stated, of another person, or of an organisation), not found, or an error."""
    kind = F.col("l_linenumber") % 5
    as_map = lambda m: F.create_map(*(F.lit(x) for kv in m.items() for x in kv))
    sd = F.when(kind == 1, as_map(_SD)).when(kind == 2, as_map(_SD | {"person_r_surname": "Жук", "birth_date": "1980-01-01", "passport_number_short": "000001"})).when(kind == 0, as_map({"org_r": "ООО Ромашка", "authinfo": "secret"}))
    reply = F.struct(
        (kind <= 2).alias("ok"), F.when(kind == 3, "not_found").when(kind == 4, "timeout").alias("code"), F.lit("").alias("message"), F.lit("1").alias("service_id"), F.col("l_suppkey").cast("string").alias("account"),
        F.when(kind == 0, "ru_org").when(kind <= 2, "ru_pp").alias("grp"), F.lit(None).cast("string").alias("contype"), sd.alias("sd"), F.lit("").alias("trustee"), F.lit("").alias("service_status"),
    )
    rows = spread(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")).select(F.col("l_orderkey").cast("string").alias("case_id"), F.col("l_linenumber").alias("pos"), F.concat("l_orderkey", F.lit("-"), "l_linenumber", F.lit(".ru")).alias("domain"), F.col("l_suppkey").cast("string").alias("account"), F.when(kind == 3, F.when(F.col("l_linenumber") == 3, "free").otherwise("registered")).alias("registry"), domain_plan.decode_reply(reply).alias("r"))
    rows = rows.select("case_id", "pos", "domain", "account", "registry", "r.status", "r.kind", "r.grp", "r.sd", "r.trustee")
    # Equal for all cases: the reference of a case is a struct beside each of its names.
    pas = NAME | {"given_name": "ПЁТР", "birth_date": "15.03.1990", "series_number": "4509 000000"}
    stated = domain_plan.reference(spark.createDataFrame([{"case_id": "x", "case_type": "x"} | case({}, pas)], checks.CASE)).select("reference")
    return rows.withColumn("reference", stated.scalar())


_ITEMS = """
WITH i AS (SELECT l_orderkey, l_linenumber AS n, l_linenumber % 5 AS k, l_suppkey FROM lineitem),
v AS (SELECT *, CASE WHEN k = 1 THEN 'ok' WHEN k = 2 THEN 'fail' WHEN k = 0 THEN 'review' ELSE '' END AS verdict,
  CASE WHEN k = 1 THEN 'ok' WHEN k = 2 THEN 'mismatch' WHEN k = 0 THEN 'review' WHEN k = 3 THEN CASE WHEN n = 3 THEN 'free' ELSE 'not_found' END ELSE 'error' END AS problem FROM i)
"""


def domain_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Each name of each list against its owner's record: verdict and problem group."""
    return domain_plan.compare(_lookups(spark, sf)).select(F.col("case_id").cast("long").alias("case_id"), F.col("pos").cast("long").alias("pos"), "verdict", "problem", F.coalesce("holder", F.lit("")).alias("holder"))


def domain_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """The checks that each list comes to."""
    s = domain_plan.summarise(domain_plan.compare(_lookups(spark, sf)))
    one = lambda name: F.coalesce(F.get(F.filter("domain_checks", lambda c: c["name"] == name), F.lit(0))["status"], F.lit(""))
    return s.select(F.col("case_id").cast("long").alias("case_id"), *(one(n).alias(a) for n, a in ((domain_plan.FOUND_CHECK, "listed"), (domain_plan.OWNER_CHECK, "owner"), (domain_plan.SAME_CHECK, "one_owner"))), F.concat_ws(",", "domain_flags").alias("flags"))


def domain_owners(spark: SparkSession, sf: str) -> DataFrame:
    """How many names each owner has in each list."""
    return domain_plan.owner_groups(domain_plan.compare(_lookups(spark, sf))).select(F.col("case_id").cast("long").alias("case_id"), F.col("holder").alias("holder"), "names", F.concat_ws(",", "problems").alias("problems"))


def shared_accounts(spark: SparkSession, sf: str) -> DataFrame:
    """Accounts of a list with several owners."""
    return domain_plan.accounts_with_several_owners(domain_plan.compare(_lookups(spark, sf))).select(F.col("case_id").cast("long").alias("case_id"), F.col("account").cast("long").alias("account"), "owners")


_HOLDER = "CASE WHEN k = 1 THEN 'Тестов Пётр Сергеевич' WHEN k = 2 THEN 'Жук Пётр Сергеевич' WHEN k = 0 THEN 'ООО Ромашка' ELSE '' END"
QUERIES |= {f.__name__: f for f in (domain_verdicts, domain_summaries, domain_owners, shared_accounts)}
ORACLE_SQL |= {
    "domain_verdicts": _ITEMS + f"SELECT l_orderkey AS case_id, CAST(n AS BIGINT) AS pos, verdict, problem, {_HOLDER} AS holder FROM v",
    "domain_summaries": _ITEMS + """SELECT l_orderkey AS case_id, CASE WHEN bool_or(k = 3) THEN 'fail' WHEN bool_or(k = 4) THEN 'review' ELSE 'ok' END AS listed,
      CASE WHEN NOT bool_or(k <= 2) THEN '' WHEN bool_or(k = 2) THEN 'fail' WHEN bool_or(k = 0) THEN 'review' ELSE 'ok' END AS owner,
      CASE WHEN count(*) FILTER (k <= 2) < 2 THEN '' WHEN count(DISTINCT k) FILTER (k <= 2) > 1 THEN 'warn' ELSE 'ok' END AS one_owner,
      CASE WHEN bool_or(k = 2) THEN 'admin_mismatch' ELSE '' END AS flags FROM v GROUP BY l_orderkey""",
    "domain_owners": _ITEMS + f"SELECT l_orderkey AS case_id, {_HOLDER} AS holder, count(*) AS names, min(problem) AS problems FROM v WHERE k <= 2 GROUP BY l_orderkey, k",
    "shared_accounts": _ITEMS + "SELECT l_orderkey AS case_id, CAST(l_suppkey AS BIGINT) AS account, count(DISTINCT k) AS owners FROM v WHERE k <= 2 GROUP BY ALL HAVING count(DISTINCT k) > 1",
}


# ---------------------------------------------------------------------------------------------------------------
# what leaves a case


def _whole_cases(spark: SparkSession, sf: str, family: str) -> DataFrame:
    """Cases with what they come to, in one projection: no case is joined with itself."""
    return evaluated(spark, sf, family, [c for c in cases(spark, sf, family).columns if c not in ("case_id", "case_type")])


def export_of_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Each case's export record as JSON, read again: the person, the document, the first name of its list, what would change."""
    whole = _whole_cases(spark, sf, "owners").select(F.to_json(outputs.export_record()).alias("j"))
    at = lambda path: F.get_json_object("j", f"$.{path}")
    return whole.select(
        at("case_id").cast("long").alias("case_id"), at("decision.code").alias("code"), F.concat_ws(" ", at("applicant.surname"), at("applicant.given_name"), at("applicant.patronymic")).alias("person"),
        F.concat_ws(" ", at("applicant.passport.series"), at("applicant.passport.number")).alias("document"), at("domains[0].punycode").alias("first_domain"), at("system_update.passport.before").alias("document_before"),
    )


def register_of_cases(spark: SparkSession, sf: str) -> DataFrame:
    """The register's row of each case."""
    rows = outputs.register_rows(_whole_cases(spark, sf, "owners"))
    return rows.select(F.col("case_id").cast("long").alias("case_id"), F.date_format("day", "yyyy-MM-dd").alias("day"), "decision", "passport", "differences", "to_review")


_OUT = "SELECT o_orderkey AS case_id, {} FROM orders JOIN (VALUES {}) AS k(kind, {}) ON o_orderkey % 5 = kind"
QUERIES |= {f.__name__: f for f in (export_of_cases, register_of_cases)}
ORACLE_SQL |= {
    "export_of_cases": _OUT.format(
        "code, 'Тестов Петр Сергеевич' AS person, document, nullif(first_domain, '') AS first_domain, nullif(document_before, '') AS document_before",
        _values([(0, "reject", "4510 111111", "a.ru", ""), (1, "reject", "4510 111111", "a.ru", "4509 000000"), (2, "reject", "4510 111111", "", ""), (3, "review", "4510 111111", "", ""), (4, "accept", " ", "", "")]), "code, document, first_domain, document_before",
    ),
    "register_of_cases": _OUT.format(
        "'2021-01-01' AS day, decision, passport, differences, to_review",
        _values([
            (0, "reject: old document", "4509 000000", "Указан прежний паспорт", ""), (1, "reject: other owner", "", "Домены администратора", ""), (2, "reject: other owner", "", "Заявитель — текущий администратор", ""),
            (3, "review: look", "4509 000000", "", "Указан прежний паспорт"), (4, "accept", "", "", ""),
        ]), "decision, passport, differences, to_review",
    ),
}


# ---------------------------------------------------------------------------------------------------------------
# streams


def _replay_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared one; only a local session may go without that setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="caseframe-")
    return f"{shared.rstrip('/')}/caseframe/replay-{uuid.uuid4().hex}"


def stream_edits_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Events as edits of a user's fields, replayed as a stream: the value given last for each, and how many there were."""
    stream = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*").select("user_id", F.col("event_type").alias("role"), F.struct("ts", "event_id").alias("at"), "value")
    out = edits.run_to_folder(edits.latest_values(stream, ["user_id", "role"], "value", "at"), _replay_folder(spark), "complete")
    return out.select("user_id", "role", F.round("value", 4).alias("value"), "edits")


def stream_cases_with_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as cases that look up some order priorities, orders as the replies that come one by one: what is known of each case and
    what is missing in the end."""
    read = lambda name: spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parquet*")
    start = F.lit("1990-01-01 00:00:00").cast("timestamp")
    asked = F.transform(F.sequence(F.lit(1), (F.col("c_custkey") % 5 + 1).cast("int")), lambda i: i.cast("string"))
    cases_ = read("customer").select(F.col("c_custkey").alias("case_id"), start.alias("at"), asked.alias("items"))
    replies = read("orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderdate").cast("timestamp").alias("at"), F.substring("o_orderpriority", 1, 1).alias("item"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("answer"))
    out = edits.run_to_folder(lookups.cases_with_replies(cases_, replies, 60 * 24 * 36500), _replay_folder(spark))
    last = out.groupBy("case_id").agg(F.max_by(F.struct("known", "missing", "state"), "version").alias("r"))
    return last.select(F.col("case_id").cast("long").alias("c_custkey"), F.array_join(F.transform("r.known", lambda k: F.concat_ws(":", k["item"], k["answer"])), " ").alias("known"), F.array_join("r.missing", " ").alias("missing"), F.col("r.state").alias("state"))


QUERIES["stream_cases_with_replies"] = stream_cases_with_replies
ORACLE_SQL["stream_cases_with_replies"] = """
WITH a AS (SELECT c_custkey, CAST(unnest(range(1, c_custkey % 5 + 2)) AS VARCHAR) AS item FROM customer),
r AS (SELECT o_custkey, left(o_orderpriority, 1) AS item, arg_max(lpad(CAST(o_orderkey AS VARCHAR), 12, '0'), (o_orderdate, o_orderkey)) AS answer FROM orders GROUP BY ALL),
j AS (SELECT a.c_custkey, a.item, r.answer FROM a LEFT JOIN r ON r.o_custkey = a.c_custkey AND r.item = a.item)
SELECT c_custkey, coalesce(string_agg(item || ':' || answer, ' ' ORDER BY item) FILTER (answer IS NOT NULL), '') AS known, coalesce(string_agg(item, ' ' ORDER BY item) FILTER (answer IS NULL), '') AS missing,
  CASE WHEN count(*) = count(answer) THEN 'complete' ELSE 'open' END AS state FROM j GROUP BY c_custkey
"""
QUERIES["stream_edits_replay"] = stream_edits_replay
ORACLE_SQL["stream_edits_replay"] = "SELECT user_id, event_type AS role, round(arg_max(value, (ts, event_id)), 4) AS value, count(*) AS edits FROM events GROUP BY user_id, event_type"
