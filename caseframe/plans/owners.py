"""A change of an account's owner: the account's card against the application, the new values, and what was saved."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseframe.functions import dates, fields
from caseframe.functions.text import digits, first_present, phone_digits, squeeze, text

#: Fields of the owner's card and their kinds; fields that are filled in, in the page's order.
OWNER_FIELDS = (
    ("person_r_surname", "text"), ("person_r_name", "text"), ("person_r_patronimic", "text"), ("birth_date", "date"), ("country", "country"),
    ("passport_number", "digits"), ("passport_date", "date"), ("passport_place", "issuer"), ("phone", "phone"),
)
FILL_FIELDS = ("person_r_surname", "person_r_name", "person_r_patronimic", "passport_number", "passport_date", "passport_place", "birth_date", "p_addr_zip", "p_addr_city", "p_addr_addr", "p_addr_recipient", "phone", "e_mail")
SAVED_KINDS = (("passport_date", "date"), ("birth_date", "date"), ("phone", "phone"), ("passport_number", "digits"), ("p_addr_zip", "digits"))
FEDERAL_CITIES = ("Москва", "Санкт-Петербург", "Севастополь")
CITY = r"(?iU)^(?:г\.|гор\.|город\s|г\s)\s*(.+?)\s*$"
CITY_AFTER = r"(?iU)^(.+?)\s+(?:г\.?|город)$"
#: Kinds of settlements, as they are written before a name.
SETTLEMENT_KINDS = ("пгт", "рп", r"р\.\s?п", "пос", "п", "с", "село", "дер", "деревня", "д", "ст-ца", "станица", "х", "хутор", "аул")
SETTLEMENT = rf"(?U)^(?:{'|'.join(SETTLEMENT_KINDS)})\.?\s+([А-ЯЁ][^\d]*?)\s*$"
DEPARTMENT = r"(?iU),?\s*(?:код\s+подразделения|к/п|код)\s*:?\s*\d{3}\s*[-–]?\s*\d{3}"


def _any_value(kind: str, card: Column, stated: Column, **options) -> Column:
    """A card may list several values; one that agrees is enough, else the first counts."""
    parts = F.filter(F.split(text(card), r"[\n,;]+"), lambda x: F.trim(x) != "")
    each = F.transform(parts, lambda p: fields.same(kind, p, stated, **options))
    return F.coalesce(F.get(F.filter(each, lambda r: r["status"] == "ok"), F.lit(0)), F.get(each, F.lit(0)), fields.result(""))


def compare_owner(card: Column, application: Column, alpha3: dict[str, str] | None = None) -> Column:
    """Array of struct(field, card, application, status) from two maps."""
    rows = []
    for name, kind in OWNER_FIELDS:
        a, b = text(card[name]), text(application[name])
        r = _any_value(kind, a, b) if kind == "phone" else fields.same(kind, a, b, **({"alpha3": alpha3 or {}} if kind == "country" else {}))
        rows.append(F.struct(F.lit(name).alias("field"), a.alias("card"), b.alias("application"), r["status"].alias("status")))
    return F.array(*rows)


def city_of(address: Column) -> Column:
    """The city of an address: a part marked as one, a federal city, else a settlement; '' without any."""
    parts = F.filter(F.transform(F.split(text(address), ","), lambda p: F.trim(p)), lambda p: p != "")

    def city(p: Column) -> Column:
        marked = first_present(F.regexp_extract(p, CITY, 1), F.regexp_extract(p, CITY_AFTER, 1))
        plain = F.translate(F.lower(F.btrim(F.regexp_replace(p, r"(?iu)^г\.?\s*", ""), F.lit(" ."))), "ё", "е")
        federal = F.coalesce(*(F.when(plain == f.lower(), f) for f in FEDERAL_CITIES))
        return F.coalesce(F.when(~marked.rlike(r"^о\."), F.btrim(marked, F.lit(" ."))), federal)

    first = lambda found: F.get(F.filter(F.transform(parts, found), lambda x: x.isNotNull()), F.lit(0))
    settlement = lambda p: F.nullif(F.btrim(F.regexp_extract(p, SETTLEMENT, 1), F.lit(" .")), F.lit(""))
    return F.coalesce(first(city), first(settlement), F.lit(""))


def clean_name(c: Column) -> Column:
    """Capitalised if it was all upper or all lower case; hyphenated parts each."""
    s = squeeze(c)
    parts = F.transform(F.split(s, "-"), F.initcap)
    return F.when((s == F.upper(s)) | (s == F.lower(s)), F.array_join(parts, "-")).otherwise(s)


def clean_phone(c: Column) -> Column:
    s, d = F.trim(text(c)), phone_digits(c)
    return F.when((F.length(d) == 11) & d.startswith("7"), F.concat(F.lit("+"), d)).when(s.startswith("+") & (d != ""), F.concat(F.lit("+"), d)).otherwise(s)


def clean_date(c: Column) -> Column:
    """A date as DD.MM.YYYY; what is no date stays as it is."""
    return F.coalesce(dates.dmy(dates.parse_date(c)), F.trim(text(c)))


def split_issued(c: Column) -> Column:
    """struct(place, date, department) of 'by whom and when issued' in one line."""
    s = squeeze(c)
    code = digits(F.regexp_extract(s, DEPARTMENT, 0))
    rest = F.trim(F.regexp_replace(s, DEPARTMENT, ""))
    day = dates.parse_date(rest)
    around = r"(?:(?:дата\s+выдачи|выдан[аоы]?|от)\s*:?\s*)?%s(?:\s*(?:года|г\.|г(?=[\s,;]|$)))?"
    worded, numeric = dates.WORDED.removeprefix("(?iU)"), (dates.NUMERIC % r"\d{4}|\d{2}").removeprefix("(?U)")
    without = F.regexp_replace(F.regexp_replace(rest, "(?iU)" + around % worded, " "), "(?iU)" + around % numeric, " ")
    place = F.regexp_replace(F.when(day.isNotNull(), without).otherwise(rest), r"(?iU)^\s*(?:выдан[аоы]?|кем\s+выдан)\s*:?\s*", "")
    department = F.when(F.length(code) == 6, F.concat_ws("-", F.left(code, F.lit(3)), F.right(code, F.lit(3)))).otherwise(code)
    return F.struct(F.btrim(squeeze(place), F.lit(" ,.;:-")).alias("place"), F.coalesce(dates.dmy(day), F.lit("")).alias("date"), department.alias("department"))


def prepare_fill(form: Column) -> Column:
    """struct(fields: a map of the values to fill in, only those that are present; notes) from a map of what was stated."""
    v = lambda k: text(form[k])
    surname, name, patronymic = (clean_name(v(k)) for k in ("surname", "name", "patronymic"))
    number = digits(v("passport"))
    issued = split_issued(v("issued"))
    address = squeeze(v("address"))
    city = first_present(v("city"), city_of(address))
    values = {
        "person_r_surname": surname, "person_r_name": name, "person_r_patronimic": patronymic,
        "passport_number": F.when(F.length(number) == 10, number).otherwise(squeeze(v("passport"))),
        "passport_date": clean_date(first_present(v("passport_date"), issued["date"])), "passport_place": squeeze(first_present(v("passport_place"), issued["place"])),
        "birth_date": clean_date(v("birth_date")), "p_addr_zip": F.regexp_replace(v("zip"), r"\s+", ""), "p_addr_city": city, "p_addr_addr": address,
        "p_addr_recipient": first_present(squeeze(v("recipient")), F.concat_ws(" ", *(F.nullif(x, F.lit("")) for x in (surname, name, patronymic)))),
        "phone": clean_phone(v("phone")), "e_mail": F.lower(v("email")),
    }
    filled = F.map_filter(F.create_map(*(x for k in FILL_FIELDS for x in (F.lit(k), text(values[k])))), lambda k, x: x != "")
    notes = F.array_compact(F.array(
        F.when((v("passport") != "") & (F.length(number) != 10), "the document number has not ten digits"), F.when(issued["department"] != "", F.concat(F.lit("the department code has no field: "), issued["department"])),
        F.when((address != "") & (text(city) == ""), "no city found in the address"), F.when(v("zip") == "", "no postal code"),
    ))
    return F.struct(filled.alias("fields"), notes.alias("notes"))


def verify_saved(saved: Column, expected: Column) -> Column:
    """Array of struct(field, expected, actual, status): ok where the saved value is the same for its kind, else fail."""
    kinds = dict(SAVED_KINDS)

    def one(name: str) -> Column:
        r = fields.same(kinds.get(name, "text"), text(saved[name]), text(expected[name]))
        row = F.struct(F.lit(name).alias("field"), text(expected[name]).alias("expected"), text(saved[name]).alias("actual"), F.when(r["status"] == "ok", "ok").otherwise("fail").alias("status"))
        return F.when(F.coalesce(F.map_contains_key(expected, name), F.lit(False)), row)

    return F.array_compact(F.array(*map(one, FILL_FIELDS)))
