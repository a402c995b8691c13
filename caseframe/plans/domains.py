"""Domain names of a case against its owner: one row for each name is compared, then each case's list is summed up.

lookups: case_id, pos, domain, status (found, not_found, error), kind (person, org, ''), grp, sd (map of registry fields),
trustee, registry (status of the public registry: free, registered, error, null) and reference (below), from join_reference().
The only shuffle is the grouping by case, which partial aggregation keeps to small structs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseframe.functions import dates, fields, issuer, names, similarity
from caseframe.functions.text import digits, first_present, fold, let, text
from caseframe.operators import grouping
from caseframe.plans import rules
from caseframe.plans.checks import FAIL, INFO, MANAGER_NAMES, OK, REVIEW, WARN, Case, Settings

ROW = "struct<field:string,sd:string,doc:string,status:string,detail:string>"
NAME_OK, NAME_REVIEW, ISSUER_OK = 90, 75, 85
FOUND_CHECK, OWNER_CHECK, PASSPORT_CHECK, SAME_CHECK = MANAGER_NAMES


def reference(cases: DataFrame) -> DataFrame:
    """case_id and reference: what a case's names are compared with, from the passport where there is one."""
    c = Case(Settings())
    name = first_present(c.passport_name, names.to_nominative(c.value("applicant_fio", "applicant_header")))
    return cases.select(
        "case_id",
        F.struct(
            name.alias("fio"),
            first_present(c.passport("birth_date"), c.value("applicant_header.birth_date")).alias("birth_date"),
            first_present(c.passport("series_number"), c.value("passport")).alias("passport"),
            first_present(c.passport("issue_date"), c.value("passport.issue_date")).alias("issue_date"),
            first_present(c.passport("issued_by"), c.value("issued_by")).alias("issued_by"),
            c.value("inn").alias("inn"),
            F.coalesce(F.transform("previous", lambda p: p["series_number"]), F.array().cast("array<string>")).alias("previous"),
        ).alias("reference"),
    )


def decode_reply(reply: Column) -> Column:
    """struct of a lookup's reply, a struct<ok, code, message, service_id, account, grp, contype, sd, trustee, service_status>."""
    failed = ~F.coalesce(reply["ok"], F.lit(False))
    code = F.coalesce(reply["code"], F.lit("error"))
    sd = F.map_filter(F.coalesce(reply["sd"], F.create_map().cast("map<string,string>")), lambda k, v: k != "authinfo")
    grp = first_present(reply["grp"], reply["contype"])
    contype = first_present(reply["contype"], reply["grp"])
    person = (contype == "ru_pp") | (text(sd["person_r_surname"]) != "")
    org = (contype == "ru_org") | (text(sd["org_r"]) != "")
    kind = F.when(F.coalesce(person, F.lit(False)), "person").when(F.coalesce(org, F.lit(False)), "org").otherwise("")
    return F.struct(
        F.when(failed & (code == "not_found"), "not_found").when(failed, "error").otherwise("found").alias("status"),
        F.when(failed, code).alias("error_code"),
        F.when(failed, reply["message"]).alias("error"),
        F.when(~failed, grp).alias("grp"),
        F.when(failed, "").otherwise(kind).alias("kind"),
        F.when(~failed, sd).alias("sd"),
        F.when(~failed, reply["trustee"]).alias("trustee"),
    )


def sd(key: str) -> Column:
    return first_present(F.col("sd")[key])


def holder_name() -> Column:
    return F.concat_ws(" ", *(sd(k) for k in ("person_r_surname", "person_r_name", "person_r_patronimic")))


def registered_passport() -> Column:
    return F.trim(F.concat_ws(" ", sd("passport_series"), sd("passport_number_short")))


def holder() -> Column:
    """Whom a name belongs to, by kind of contact."""
    native = F.concat_ws(" ", *(sd(k) for k in ("o_last_name_ru", "o_first_name_ru", "o_patronimic_ru")))
    latin = F.concat_ws(" ", *(sd(k) for k in ("o_last_name", "o_first_name", "o_patronimic")))
    other = first_present(sd("o_company_ru"), sd("o_company"), native, latin)
    return F.when(F.col("kind") == "person", holder_name()).when(F.col("kind") == "org", first_present(sd("org_r"), sd("org"))).otherwise(other)


def _row(field: str, own: Column, doc: Column, status: Column | str, detail: str = "") -> Column:
    s = F.lit(status) if isinstance(status, str) else status
    return F.struct(F.lit(field).alias("field"), text(own).alias("sd"), text(doc).alias("doc"), s.alias("status"), F.lit(detail).alias("detail"))


def compare(lookups: DataFrame) -> DataFrame:
    """lookups with compared (an array of rows), verdict (the worst status, '' if not found) and problem."""
    own = F.struct(F.col("reference").alias("r"), holder_name().alias("name"), registered_passport().alias("passport"), digits(registered_passport()).alias("number"), sd("birth_date").alias("born"))
    trustee = F.when(F.lower(text("trustee")) == "да", _row("trustee", F.col("trustee"), F.lit(""), INFO))
    other = _row("group", F.col("grp"), F.lit(""), REVIEW, "kind of contact not supported")
    rows = F.when(F.col("kind") == "person", let(own, lambda x: _compared_person(x, trustee))).when(F.col("kind") == "org", _compared_org(trustee)).otherwise(F.array_compact(F.array(other, trustee)))
    out = lookups.withColumn("compared", F.when(F.col("status") == "found", rows).otherwise(F.array().cast(f"array<{ROW}>")))
    out = out.withColumn("verdict", grouping.worst(F.transform("compared", lambda x: x["status"])))
    return out.withColumn("problem", grouping.problem(F.col("status"), F.col("registry"), F.col("verdict"))).withColumn("holder", holder())


def _compared_org(trustee: Column) -> Column:
    r = F.col("reference")
    both = lambda a, b: (text(a) != "") & (text(b) != "")
    number = F.when(digits(sd("code")) == digits(r["inn"]), OK).otherwise(FAIL)
    org = [F.when(both(sd("code"), r["inn"]), _row("code", sd("code"), r["inn"], number)), _row("org_r", first_present(sd("org_r"), sd("org")), r["fio"], REVIEW, "registered to an organisation")]
    return F.array_compact(F.array(*org, trustee))


def _compared_person(x: Column, trustee: Column) -> Column:
    """x: struct(r: the reference; name, passport, its digits as number, and born of the record)."""
    r, own_name, own_passport = x["r"], x["name"], x["passport"]
    both = lambda a, b: (text(a) != "") & (text(b) != "")
    by_score = lambda score: F.when(score >= NAME_OK, OK).when(score >= NAME_REVIEW, REVIEW).otherwise(FAIL)
    name_status = F.when(~both(own_name, r["fio"]), REVIEW).otherwise(let(names.name_similarity(own_name, r["fio"]), by_score))
    born = x["born"]
    born_status = F.when(~both(born, r["birth_date"]), REVIEW).when(born == r["birth_date"], OK).when(dates.parse_date(dates.iso_to_dmy(born)).eqNullSafe(dates.parse_date(dates.iso_to_dmy(r["birth_date"]))), OK).otherwise(FAIL)
    same_number = both(own_passport, r["passport"]) & (x["number"] == digits(r["passport"]))
    earlier = F.exists(r["previous"], lambda p: digits(p) == x["number"])
    issued, place = sd("passport_date"), sd("passport_place")
    issued_status = F.when(dates.parse_date(dates.iso_to_dmy(issued)).eqNullSafe(dates.parse_date(dates.iso_to_dmy(r["issue_date"]))), OK).otherwise(WARN)
    place_status = F.when(issuer.issuer_similarity(place, r["issued_by"]) >= ISSUER_OK, OK).otherwise(WARN)

    def person(m: Column) -> Column:
        passport_status = F.when(~both(own_passport, r["passport"]), REVIEW).when(m["same"], OK).when(earlier | (m["name"] == OK) & (m["born"] == OK), INFO).otherwise(FAIL)
        return F.array_compact(F.array(
            _row("fio", own_name, r["fio"], m["name"]), _row("birth_date", born, r["birth_date"], m["born"]), _row("passport", own_passport, r["passport"], passport_status),
            F.when(m["same"] & both(issued, r["issue_date"]), _row("passport_date", issued, r["issue_date"], issued_status)),
            F.when(m["same"] & both(place, r["issued_by"]), _row("passport_place", place, r["issued_by"], place_status)), trustee,
        ))

    return let(F.struct(name_status.alias("name"), born_status.alias("born"), same_number.alias("same")), person)


def owner_key() -> Column:
    """What tells owners apart: passport digits or folded name of a person, tax number or folded name of an organisation."""
    person = first_present(digits(registered_passport()), fold(holder_name()))
    return F.struct(F.col("kind").alias("kind"), F.when(F.col("kind") == "person", person).otherwise(first_present(digits(sd("code")), fold(F.col("holder")))).alias("key"))


def summarise(compared: DataFrame) -> DataFrame:
    """case_id, domain_checks and domain_flags for each case with lookups."""
    failed = F.exists("compared", lambda x: x["field"].isin("fio", "birth_date", "passport") & (x["status"] == FAIL))
    document = F.filter("compared", lambda x: x["field"].isin("passport", "passport_date", "passport_place") & x["status"].isin(INFO, WARN))
    same_passport = F.exists("compared", lambda x: (x["field"] == "passport") & (x["status"] == OK))
    found, person = F.col("status") == "found", F.col("kind") == "person"
    flat = compared.select(
        "case_id", "pos", "domain", "status", "registry", "holder", F.col("reference.fio").alias("fio"), F.col("reference.passport").alias("doc"),
        (found & person & failed).alias("bad"), (found & ((F.col("verdict") == REVIEW) | ~person)).alias("unsure"), (found & person).alias("person"),
        (found & person & (F.size(document) > 0)).alias("stale"), (found & person & F.exists(document, lambda x: x["status"] == WARN)).alias("stale_warn"), (found & person & same_passport).alias("same_passport"),
        F.when(found, owner_key()).alias("owner"),
    )
    listed = lambda condition, order, what: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct(*order, what.alias("x"))))), lambda x: x["x"]), ", ")
    free_first = F.when(F.col("registry") == "free", 0).otherwise(1).alias("free")
    c = flat.groupBy("case_id").agg(
        F.count_if(F.col("status") == "found").alias("found"), F.count_if(F.col("status") == "not_found").alias("missing"), F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if("bad").alias("bad"), F.count_if("unsure").alias("unsure"), F.count_if("person").alias("persons"), F.count_if("stale").alias("stale"), F.count_if("stale_warn").alias("stale_warn"),
        F.count_if("same_passport").alias("same_passport"), F.size(F.collect_set("owner")).alias("owners"), F.first("fio", True).alias("fio"), F.first("doc", True).alias("doc"),
        listed(F.lit(True), ["pos"], F.col("domain")).alias("names"), listed(F.col("status") == "not_found", [free_first, "pos"], F.col("domain")).alias("absent"),
        listed(F.col("status") == "error", ["pos"], F.col("domain")).alias("unread"), listed(F.col("status") == "found", ["pos"], F.concat_ws(": ", "domain", "holder")).alias("holders"),
    )
    any_found = F.col("found") > 0
    status = F.when(F.col("missing") > 0, FAIL).when(F.col("errors") > 0, REVIEW).otherwise(OK)
    owner = F.when(F.col("bad") > 0, FAIL).when(F.col("unsure") > 0, REVIEW).otherwise(OK)
    paper = F.when(F.col("stale_warn") > 0, WARN).when(F.col("stale") > 0, INFO).when((F.col("persons") > 0) & (F.col("same_passport") == F.col("persons")), OK)
    checks = rules.gather(
        rules.check(FOUND_CHECK, status, F.col("names"), None, F.when(F.col("missing") > 0, F.col("absent")).when(F.col("errors") > 0, F.col("unread"))),
        F.when(any_found, rules.check(OWNER_CHECK, owner, F.col("fio"), F.col("holders"))),
        F.when(any_found & paper.isNotNull(), rules.check(PASSPORT_CHECK, paper, F.col("doc"))),
        F.when(F.col("found") > 1, rules.check(SAME_CHECK, F.when(F.col("owners") > 1, WARN).otherwise(OK), None, F.col("holders"))),
    )
    flags = F.when(F.col("bad") > 0, F.array(F.lit("admin_mismatch"))).otherwise(F.array().cast("array<string>"))
    return c.select("case_id", checks.alias("domain_checks"), flags.alias("domain_flags"))


# ---------------------------------------------------------------------------------------------------------------
# the registry's record against the state register's

#: Registry field, path in the state register's record, kind of value.
PERSON_FIELDS = (
    ("person_r_surname", "last_name", "text"), ("person_r_name", "first_name", "text"), ("person_r_patronimic", "middle_name", "text"), ("birth_date", "birth_date", "date"), ("country", "citizenship", "country"),
    ("passport_series", "rf_passport.series", "digits"), ("passport_number_short", "rf_passport.number", "digits"), ("passport_date", "rf_passport.issue_date", "date"), ("passport_place", "rf_passport.issued_by", "issuer"),
)
ORG_FIELDS = (
    ("code", "inn", "digits"), ("kpp", "kpp", "digits"), ("org_r", "full_name", "org"), ("address_r_street", "legal_address.street", "street"), ("address_r_house", "legal_address.house", "house"), ("address_r_zip", "legal_address.zip_code", "digits"),
)


def _house(base: Column, frame: Column, building: Column) -> Column:
    extra = [F.when(text(v) != "", F.concat(F.lit(f"{mark} "), v)) for mark, v in (("корп.", frame), ("стр.", building))]
    return F.concat_ws(", ", base, *extra)


def compare_identity(record: Column, kind: Column, alpha3: dict[str, str] | None = None) -> Column:
    """Array of struct(field, status, score); record is the state register's JSON, and only the listed fields are read of it."""
    at = lambda path: first_present(F.get_json_object(record, f"$.{path}"))

    def one(field: str, path: str, how: str) -> Column:
        if how == "house":
            whole = _house(sd(field), sd("address_r_frame"), sd("address_r_building")), _house(at(path), at("legal_address.frame"), at("legal_address.building"))
            result = fields.best(*(fields.same_house(a, b) for a in (whole[0], sd(field)) for b in (whole[1], at(path))))
        elif how == "date":
            result = fields.same(how, dates.iso_to_dmy(sd(field)), dates.iso_to_dmy(at(path)))
        elif how == "country":
            result = fields.same(how, sd(field), at(path), alpha3=alpha3 or {})
        else:
            result = fields.same(how, sd(field), at(path))
        return F.struct(F.lit(field).alias("field"), result["status"].alias("status"), result["score"].alias("score"))

    closed = F.when(F.get_json_object(record, "$.is_liquidated") == "true", F.struct(F.lit("is_liquidated").alias("field"), F.lit("fail").alias("status"), F.lit(None).cast("double").alias("score")))
    person = F.array(*(one(*f) for f in PERSON_FIELDS))
    org = F.array_compact(F.array(*(one(*f) for f in ORG_FIELDS), closed))
    return F.when(kind == "person", person).when(kind == "org", org)


def identity_state(status: Column, kind: Column, state: Column, compared: Column) -> Column:
    """One word for how an identification stands. state: struct<error, count, data> (null: no link); data is JSON."""
    known = F.filter(compared, lambda x: x["status"] != "")
    has = lambda s: F.exists(known, lambda x: x["status"] == s)
    data_status = F.coalesce(F.get_json_object(state["data"], "$.status"), F.lit("success"))
    return (
        F.when((status != "found") | ~kind.isin("person", "org"), "").when(state.isNull(), "no_link").when(text(state["error"]) != "", "error")
        .when(F.coalesce(state["count"], F.lit(0)) == 0, "none").when(text(state["data"]) == "", "no_data").when(data_status != "success", "error")
        .when(F.coalesce(F.size(known), F.lit(0)) <= 0, "no_data").when(has("fail"), "mismatch").when(has("warn"), "warn").otherwise("match")
    )


# ---------------------------------------------------------------------------------------------------------------
# reports over the whole list


def owner_groups(compared: DataFrame) -> DataFrame:
    """One row for each case and owner: how many names, which problems, accounts and addresses, the largest first."""
    own = compared.where("status = 'found'").withColumn("owner", owner_key())
    return own.groupBy("case_id", "owner").agg(
        F.min("holder").alias("holder"), F.count(F.lit(1)).alias("names"), F.array_sort(F.collect_set("account")).alias("accounts"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split(F.lower(text(first_present(sd("e_mail"), sd("o_email")))), r"[\s,;<>]+"))))).alias("mails"), F.array_sort(F.collect_set("problem")).alias("problems"),
    ).orderBy("case_id", F.desc("names"), "holder")


def accounts_with_several_owners(compared: DataFrame) -> DataFrame:
    return grouping.several_values(compared.where("status = 'found' AND account <> ''").withColumn("owner", owner_key()), ["case_id", "account"], F.col("owner"), "owners")


def inconsistent_documents(compared: DataFrame, key: str) -> DataFrame:
    """Rarer values of a field among the names registered with one passport."""
    own = compared.where("status = 'found' AND kind = 'person'").withColumn("passport", digits(registered_passport())).where("passport <> ''").withColumn("value", text(sd(key))).where("value <> ''")
    return grouping.rare_values(own, ["case_id", "passport"], "value")


def similar_known(compared: DataFrame, least: float = 0.85) -> DataFrame:
    """For names that are not found: the name of the same case most like it, where its similarity is enough. A case bounds the
    pairs, and only names whose lengths allow the similarity meet."""
    label = F.regexp_replace(F.regexp_replace("domain", r"\.[^.]*$", ""), "-", "")
    own = compared.select("case_id", "domain", "status", label.alias("label"))
    missing, other = own.where("status = 'not_found'"), own.where("status <> 'not_found'").select("case_id", F.col("domain").alias("known"), F.col("label").alias("known_label"))
    near = missing.join(other, "case_id").where(2 * F.least(F.length("label"), F.length("known_label")) >= least * (F.length("label") + F.length("known_label")))
    scored = near.withColumn("score", similarity.matching_blocks_ratio("label", "known_label")).where(F.col("score") >= least)
    best = scored.groupBy("case_id", "domain").agg(F.min(F.struct((-F.col("score")).alias("minus"), "known")).alias("b"))
    return best.select("case_id", "domain", "b.known", (-F.col("b.minus")).alias("score"))
