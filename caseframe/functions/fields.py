"""Comparison of one value from two sources, by kind: a struct of status ('ok', 'warn', 'fail' or '' with nothing to
compare) and score (similarity where one was computed)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseframe.functions.dates import dmy, parse_date
from caseframe.functions.issuer import issuer_similarity
from caseframe.functions.similarity import token_set_ratio
from caseframe.functions.text import ColumnOrName, bound, country_code, digits, let, phone_digits, text, word_key

OK, WARN, FAIL, NONE = "ok", "warn", "fail", ""
ALIKE = 85.0


def result(status: Column | str, score: Column | None = None) -> Column:
    s = F.lit(status) if isinstance(status, str) else status
    return F.struct(s.alias("status"), (score if score is not None else F.lit(None).cast("double")).alias("score"))


def normal(kind: str, c: ColumnOrName, alpha3: dict[str, str] | None = None, as_of: date | None = None) -> Column:
    """A value in the form in which it is compared."""
    if kind == "date":
        return F.coalesce(dmy(parse_date(c, as_of)), F.regexp_replace(text(c), r"(?U)\s+", ""))
    if kind == "digits":
        return digits(c)
    if kind == "phone":
        return phone_digits(c)
    if kind == "country":
        return country_code(c, alpha3 or {})
    return word_key(c)


def same(kind: str, a: ColumnOrName, b: ColumnOrName, **options) -> Column:
    if kind in SPECIAL:
        return SPECIAL[kind](a, b)
    score = issuer_similarity(a, b) if kind == "issuer" else F.lit(None).cast("double")
    both = F.struct(normal(kind, a, **options).alias("x"), normal(kind, b, **options).alias("y"), score.alias("score"))

    def judge(s: Column) -> Column:
        missing = (s["x"] == "") | (s["y"] == "")
        unlike = result(F.when(s["score"] >= ALIKE, WARN).otherwise(FAIL), s["score"])
        return F.when(missing, result(NONE)).when(s["x"] == s["y"], result(OK)).otherwise(unlike)

    return let(both, judge)


# ---------------------------------------------------------------------------------------------------------------
# organisations

#: Legal forms in full and what codes they share; then abbreviations.
FORM_PHRASES = (
    ("общество с ограниченной ответственностью", ("ООО",)), ("общество с дополнительной ответственностью", ("ОДО",)),
    ("непубличное акционерное общество", ("АО",)), ("акционерное общество", ("АО",)), ("публичное акционерное общество", ("ПАО",)),
    ("открытое акционерное общество", ("ОАО",)), ("закрытое акционерное общество", ("ЗАО",)),
    ("производственный кооператив", ("ПК",)), ("потребительский кооператив", ("ПОТРК",)),
    ("хозяйственное товарищество", ("ХТ", "ПТ", "ТВ")), ("полное товарищество", ("ПТ", "ХТ")),
    ("товарищество на вере", ("ТВ", "ХТ")), ("коммандитное товарищество", ("ТВ", "ХТ")),
    ("автономная некоммерческая организация", ("АНО",)), ("федеральное государственное унитарное предприятие", ("ФГУП",)),
    ("государственное унитарное предприятие", ("ГУП",)), ("муниципальное унитарное предприятие", ("МУП",)),
)
FORM_ABBREVIATIONS = (
    ("ооо", ("ООО",)), ("одо", ("ОДО",)), ("ао", ("АО",)), ("нао", ("АО",)), ("нпао", ("АО",)), ("пао", ("ПАО",)), ("оао", ("ОАО",)),
    ("зао", ("ЗАО",)), ("пк", ("ПК", "ПОТРК")), ("хт", ("ХТ", "ПТ", "ТВ")), ("пт", ("ПТ", "ХТ")), ("тв", ("ТВ", "ХТ")),
    ("кт", ("ТВ", "ХТ")), ("ано", ("АНО",)), ("фгуп", ("ФГУП",)), ("гуп", ("ГУП",)), ("муп", ("МУП",)),
)
QUOTES = "\"«»“”„‟'‘’`"


def _codes(of: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, of))


def _take_phrases(words: Column) -> tuple[Column, Column]:
    """(words without legal forms in full, the forms' codes)."""
    left, codes = F.concat(F.lit(" "), words, F.lit(" ")), F.array().cast("array<string>")
    for phrase, of in sorted(FORM_PHRASES, key=lambda x: -len(x[0])):
        there = left.contains(f" {phrase} ")
        codes = F.concat(codes, F.when(there, _codes(of)).otherwise(F.array().cast("array<string>")))
        left = F.replace(left, F.lit(f" {phrase} "), F.lit(" "))
    return F.trim(left), codes


def _abbreviations(words: Column) -> Column:
    """Codes of the words that are abbreviations of legal forms."""
    found = [F.when(F.array_contains(words, a), _codes(of)).otherwise(F.array().cast("array<string>")) for a, of in FORM_ABBREVIATIONS]
    return F.concat(*found)


@bound(1)
def organisation(c: ColumnOrName) -> Column:
    """struct(forms, name): codes of the legal form, and the name without form and quotes.

    With two quotes or more the name is what the outer ones enclose, and the form stands outside. Without, a form in
    full counts anywhere and abbreviations only at the ends."""
    v = text(c)
    mark = f"[{QUOTES}]"
    quoted = v.rlike(f"(?s){mark}.*{mark}")
    inner = word_key(F.regexp_extract(v, f"(?s){mark}(.*){mark}", 1))
    outside, outer_codes = _take_phrases(word_key(F.regexp_replace(v, f"(?s){mark}.*{mark}", " ")))
    outer_codes = F.concat(outer_codes, _abbreviations(F.split(outside, " ")))
    bare, bare_codes = _take_phrases(word_key(v))
    short = "|".join(a for a, _ in FORM_ABBREVIATIONS)
    head, tail = F.regexp_extract(bare, rf"^((?:(?:{short})(?: |$))*)", 1), F.regexp_extract(bare, rf"((?:(?:^| )(?:{short}))*)$", 1)
    name = F.trim(F.regexp_replace(F.regexp_replace(bare, rf"^(?:(?:{short})(?: |$))+", ""), rf"(?:(?:^| )(?:{short}))+$", ""))
    bare_codes = F.concat(bare_codes, _abbreviations(F.split(F.trim(F.concat(head, F.lit(" "), tail)), " +")))
    return F.when(quoted, F.struct(F.array_distinct(outer_codes).alias("forms"), inner.alias("name"))).otherwise(F.struct(F.array_distinct(bare_codes).alias("forms"), name.alias("name")))


@bound(2)
def same_organisation(a: ColumnOrName, b: ColumnOrName) -> Column:
    x, y = organisation(a), organisation(b)
    forms = (F.size(x["forms"]) > 0) & (F.size(y["forms"]) > 0)
    one_form = (F.size(x["forms"]) > 0) != (F.size(y["forms"]) > 0)
    empty = ((x["name"] == "") & (F.size(x["forms"]) == 0)) | ((y["name"] == "") & (F.size(y["forms"]) == 0))
    status = F.when(empty, NONE).when(x["name"] != y["name"], FAIL).when(forms & ~F.arrays_overlap(x["forms"], y["forms"]), FAIL).when(one_form, WARN).otherwise(OK)
    return result(status)


# ---------------------------------------------------------------------------------------------------------------
# addresses

#: Marks of a building's parts, and words that say nothing.
HOUSE_MARKS = (("к", "к"), ("корп", "к"), ("корпус", "к"), ("кор", "к"), ("стр", "стр"), ("строение", "стр"), ("с", "стр"), ("лит", "лит"), ("литер", "лит"), ("литера", "лит"))
HOUSE_WORDS = ("д", "дом", "n")
STREET_TYPES = (
    ("улица|ул", "ул"), ("проезд|пр-?д", "пр-д"), ("проспект|пр-?кт|просп|пр-?т|пр", "пр-кт"), ("переулок|пер", "пер"), ("бульвар|б-?р|бул", "б-р"),
    ("шоссе|ш", "ш"), ("площадь|пл", "пл"), ("набережная|наб", "наб"), ("тупик|туп", "туп"), ("аллея|ал", "ал"), ("микрорайон|мкр-?н|мкр", "мкр"),
    ("квартал|кв-?л", "кв-л"), ("территория|тер", "тер"), ("линия|лин", "лин"), ("дорога|дор", "дор"), ("тракт", "тракт"), ("километр|км", "км"),
    ("спуск", "спуск"), ("въезд", "въезд"), ("просека", "просека"), ("городок", "городок"),
)


@bound(1)
def house_key(c: ColumnOrName) -> Column:
    """Tokens of a house number: marks in one spelling, empty words left out, a letter joined to the number before."""
    v = F.translate(F.lower(text(c)), "ё", "е")
    v = F.regexp_replace(F.regexp_replace(v, "[^0-9a-zа-я/]+", " "), "(?<=[a-zа-я])(?=[0-9])", " ")
    parts = F.filter(F.split(v, " "), lambda t: (t != "") & ~t.isin(*HOUSE_WORDS))
    mark = F.create_map(*(F.lit(x) for pair in HOUSE_MARKS for x in pair))

    def step(done: Column, t: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (F.length(t) == 1) & t.rlike("[a-zа-я]") & (F.size(done) > 0)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(last, t)))
        return F.when(mark[t].isNotNull(), F.concat(done, F.array(mark[t]))).when(joins & last.rlike("^[0-9]"), joined).otherwise(F.concat(done, F.array(t)))

    return F.aggregate(parts, F.array().cast("array<string>"), step)


@bound(2)
def same_house(a: ColumnOrName, b: ColumnOrName) -> Column:
    x, y = house_key(a), house_key(b)
    number = lambda k: F.regexp_extract(F.get(k, F.lit(0)), "^[0-9]+", 0)
    status = F.when((F.size(x) == 0) | (F.size(y) == 0), NONE).when(x == y, OK).when((number(x) != "") & (number(x) == number(y)), WARN).otherwise(FAIL)
    return result(status)


@bound(1)
def street(c: ColumnOrName) -> Column:
    """struct(types, name)."""
    v, types = F.translate(F.lower(text(c)), "ё", "е"), []
    for pattern, canon in STREET_TYPES:
        whole = rf"(?<![0-9a-zа-я])(?:{pattern})\.?(?![0-9a-zа-я])"
        types.append(F.when(v.rlike(whole), canon))
        v = F.regexp_replace(v, whole, " ")
    words = F.filter(F.split(word_key(v), " "), lambda w: ~w.isin("", "им", "имени"))
    return F.struct(F.array_compact(F.array(*types)).alias("types"), F.array_join(words, " ").alias("name"))


@bound(2)
def same_street(a: ColumnOrName, b: ColumnOrName) -> Column:
    x, y = street(a), street(b)
    score = token_set_ratio(x["name"], y["name"])
    other_type = (F.size(x["types"]) > 0) & (F.size(y["types"]) > 0) & ~F.arrays_overlap(x["types"], y["types"])
    return (
        F.when((x["name"] == "") | (y["name"] == ""), result(NONE))
        .when(x["name"] == y["name"], result(F.when(other_type, WARN).otherwise(OK)))
        .otherwise(result(F.when(score >= ALIKE, WARN).otherwise(FAIL), score))
    )


SPECIAL = {"org": same_organisation, "house": same_house, "street": same_street}
#: Which of several comparisons counts: agreement first, nothing to compare last.
BEST_FIRST = (OK, WARN, FAIL, NONE)


def best(*results: Column) -> Column:
    """The best of several comparisons, the first of equal ones."""
    ranks = F.create_map(*(x for i, s in enumerate(BEST_FIRST) for x in (F.lit(s), F.lit(i))))
    return F.array_min(F.array(*(F.struct(ranks[r["status"]].alias("rank"), F.lit(i).alias("place"), r.alias("result")) for i, r in enumerate(results))))["result"]
