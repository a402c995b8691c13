"""What leaves a checked case: the export record, changes for the system of record, the result, rows of the register.

rows: case_id, case_type, as_of, app and pas (maps of fields), admin, previous, confirmed, and checks, flags and decision as evaluate()
gives them. All of it is one projection; writing goes to folders by day, so that no case has files of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseframe.functions import names
from caseframe.functions.text import digits, first_present, fold, text, to_punycode
from caseframe.plans.checks import Case, Settings

SCHEMA = "caseframe.case.v1"


def _title(c: Column) -> Column:
    return F.initcap(fold(c))


def export_record(order: tuple[str, ...] = ("surname", "given_name", "patronymic")) -> Column:
    """The record that fills in another system's form: a person's data from the document where there is one, else as stated."""
    c = Case(Settings())
    stated = F.split(names.to_nominative(c.value("applicant_fio", "applicant_header")), " ")
    person = [F.when(c.passport("surname").isNotNull(), text(c.passport(part))).otherwise(text(F.get(stated, F.lit(i)))) for i, part in enumerate(order)]
    number = digits(first_present(c.passport("series_number"), c.value("passport")))
    whole = F.length(number) >= 10
    listed = F.coalesce(c.field("domains.list")["list"], F.array().cast("array<string>"))
    several = lambda *roles: F.coalesce(*(F.nullif(c.field(r)["list"], F.array().cast("array<string>")) for r in roles), F.array().cast("array<string>"))
    plain = F.map_filter(F.col("app"), lambda k, v: ~k.contains("."))
    return F.struct(
        F.lit(SCHEMA).alias("schema"), F.col("case_id"), F.col("case_type"), F.col("decision"),
        F.struct(
            *(_title(p).alias(n) for p, n in zip(person, order, strict=True)),
            first_present(c.passport("birth_date"), c.value("applicant_header.birth_date")).alias("birth_date"), c.passport("birth_place").alias("birth_place"), c.passport("sex").alias("sex"),
            F.struct(
                F.when(whole, F.left(number, F.lit(4))).otherwise("").alias("series"), F.when(whole, F.substring(number, 5, 6)).otherwise("").alias("number"), first_present(c.passport("issue_date"), c.value("passport.issue_date")).alias("issue_date"),
                first_present(c.passport("issued_by"), c.value("issued_by")).alias("issued_by"), c.passport("department_code").alias("department_code"),
            ).alias("passport"),
            c.value("address").alias("address"), c.value("inn").alias("inn"),
        ).alias("applicant"),
        F.transform(listed, lambda d: F.struct(d.alias("name"), to_punycode(d).alias("punycode"))).alias("domains"), c.value("services").alias("services"),
        F.struct(
            F.coalesce(c.value("new_admin_fio.kind"), F.when(c.value("new_admin_org").isNotNull(), "org"), F.lit("")).alias("kind"), c.value("new_admin_fio", "new_admin_org", "new_admin_inline").alias("name"),
            several("new_admin_contact.emails", "new_admin_org_contact.emails").alias("emails"), several("new_admin_contact.phones", "new_admin_org_contact.phones").alias("phones"), c.value("new_admin_contact", "new_admin_org_contact").alias("contacts_raw"),
        ).alias("new_admin"),
        c.value("contract").alias("contract"), c.value("application_date").alias("application_date"), F.transform_values(plain, lambda k, v: v["value"]).alias("application_fields"),
        F.array_sort(F.coalesce("confirmed", F.array().cast("array<string>"))).alias("confirmed_by_operator"), F.col("previous").alias("previous_passports"), system_update().alias("system_update"), F.col("checks"),
    )


def system_update() -> Column:
    """A map of what the system of record would change: attribute to struct(before, after), where both are there and differ."""
    c, a = Case(Settings()), F.col("admin")
    pairs = {
        "passport": (a["passport"], c.passport("series_number"), digits), "passport_issue_date": (a["passport_issue_date"], c.passport("issue_date"), text), "passport_issued_by": (a["passport_issued_by"], c.passport("issued_by"), fold),
    }
    entries = []
    for name, (old, new, key) in pairs.items():
        differs = (text(old) != "") & (text(new) != "") & (key(old) != key(new))
        entries.append(F.when(differs & F.col("pas").isNotNull(), F.struct(F.lit(name).alias("key"), F.struct(old.alias("before"), new.alias("after")).alias("value"))))
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def result() -> Column:
    """All of a case for an interface: decision, checks, fields of both sides, record."""
    return F.struct("case_id", "decision", F.col("app").alias("application"), F.col("pas").alias("passport"), "checks", export_record().alias("record"))


def _named(*statuses: str) -> Column:
    return F.array_join(F.transform(F.filter("checks", lambda x: x["status"].isin(*statuses)), lambda x: x["name"]), "; ")


def register_rows(rows: DataFrame) -> DataFrame:
    """A row for the register of each case."""
    c = Case(Settings())
    decision = F.concat_ws(": ", "decision.code", F.nullif(F.array_join("decision.reasons", "; "), F.lit("")))
    v = lambda *roles: text(c.value(*roles))
    return rows.select(
        F.col("as_of").alias("day"), "case_id", decision.alias("decision"), v("applicant_header", "applicant_fio").alias("applicant"), v("passport").alias("passport"), v("domains").alias("domains"),
        v("new_admin_fio", "new_admin_org", "new_admin_inline").alias("new_admin"), v("new_admin_contact").alias("contacts"), v("contract").alias("contract"), _named("fail").alias("differences"), _named("review", "warn").alias("to_review"),
    )


def save_outputs(rows: DataFrame, folder: str) -> None:
    """result and export as JSON lines and the register as Parquet, by day. A day that is written again replaces only itself, so
    that a run can be repeated."""
    day = F.col("as_of").alias("day")
    for name, record in (("result", result()), ("export", export_record())):
        rows.select(day, record.alias("r")).select("day", "r.*").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").json(f"{folder}/{name}")
    register_rows(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{folder}/register")
