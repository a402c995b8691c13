"""What a form's fields become beside one another: plausible values, a section's values merged in, pages and lines of a scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseframe.functions import names, similarity
from caseframe.functions.text import let, present, squeeze, text
from caseframe.plans.checks import FIELD
from caseframe.plans.forms import EMAIL, ORGANISATION, PHONE, SECTION, TYPES, _field, clean, detect

#: The roles of a section about a new owner, by the parts of new_owner_section().
OWNER_ROLES = {"org": "new_admin_org", "person": "new_admin_fio", "org_contact": "new_admin_org_contact", "contact": "new_admin_contact"}
#: Letters and digits below which a text is read by patterns even where a model is switched on.
MODEL_LEAST = 40
MODEL, OCR_TEXT = "llm", "ocr-text"


def usable(part: str, value: Column) -> Column:
    """Whether a value of a section's part is one, and no scrap of the printed form."""
    v = text(value)
    owner_name = F.size(names.extract_name(F.regexp_replace(v, r"(?U)^ИП\b", ""))) >= 2
    fits = {"org": v.rlike(ORGANISATION), "person": owner_name | v.rlike(ORGANISATION), "org_contact": v.rlike(EMAIL) | v.rlike(PHONE), "contact": v.rlike(EMAIL) | v.rlike(PHONE)}
    return (v != "") & fits[part]


def _entry_of(role: str, kind: str, value: Column, confidence: float, source: str) -> Column:
    """The (key, field) entries of a section's value, parsed by its field's type."""
    cleaned = clean(value)
    parts = TYPES.get(kind, TYPES["text"])(cleaned, value)
    return F.array(*(F.struct(F.lit(role + (f".{sub}" if sub else "")).alias("key"), _field(sub, v, confidence, source, value, parts[""]).alias("value")) for sub, v in parts.items()))


def merge_section(fields: Column, block: Column, form: Mapping, confidence: float = SECTION, source: str = "text", roles: Mapping[str, str] = OWNER_ROLES) -> Column:
    """Fields with a section's values: implausible ones go, empty ones are filled from the section, an operator's stay; an
    organisation's contacts without an organisation are the person's. block: the struct of new_owner_section()."""
    kinds = {spec.get("role", name): spec.get("type", "text") for name, spec in form["fields"].items()}
    known = {part: role for part, role in roles.items() if role in kinds}

    def own(s: Column) -> Column:
        """For each part its present value, whether it stays, whether an operator gave it, and the section's value."""
        columns = []
        for part, role in known.items():
            value, manual = s["f"][role]["value"], text(s["f"][role]["source"]) == "manual"
            columns += [value.alias(part), (manual | usable(part, value)).alias(f"{part}_stays"), manual.alias(f"{part}_manual"), F.nullif(text(s["b"][part]), F.lit("")).alias(f"{part}_new")]
        return let(F.struct(s["f"].alias("f"), *columns), merged)

    def merged(v: Column) -> Column:
        stays, new = {p: v[f"{p}_stays"] for p in known}, {p: F.when(~v[f"{p}_stays"], v[f"{p}_new"]) for p in known}
        if {"org", "org_contact", "contact"} <= set(known):
            no_org = ~(stays["org"] | new["org"].isNotNull())
            orphan = F.coalesce(new["org_contact"], F.when(stays["org_contact"] & ~v["org_contact_manual"], v["org_contact"]))
            new["contact"] = F.when(~stays["contact"], F.coalesce(new["contact"], F.when(no_org, orphan)))
            new["org_contact"] = F.when(~no_org, new["org_contact"])
            stays["org_contact"] = stays["org_contact"] & (~no_org | v["org_contact_manual"])
        kept = F.array_compact(F.array(*(F.when(stays[p], F.lit(role)) for p, role in known.items())))
        touched = F.array(*map(F.lit, known.values()))
        return let(F.struct(v["f"].alias("f"), kept.alias("kept"), *(new[p].alias(p) for p in known)), lambda x: put_together(x, touched))

    def put_together(x: Column, touched: Column) -> Column:
        none = F.array().cast(f"array<struct<key:string,value:{FIELD}>>")
        head = lambda k: F.split_part(k, F.lit("."), F.lit(1))
        left = F.map_filter(x["f"], lambda k, _: ~F.array_contains(touched, head(k)) | F.array_contains(x["kept"], head(k)))
        parsed = lambda role: lambda value: _entry_of(role, kinds[role], value, confidence, source)
        made = [F.when(x[p].isNotNull(), let(x[p], parsed(role))).otherwise(none) for p, role in known.items()]
        return F.map_concat(left, F.map_from_entries(F.concat(*made)))

    return let(F.struct(fields.alias("f"), block.alias("b")), own)


# ---------------------------------------------------------------------------------------------------------------
# how fields were read


def reader(fields: Column, enabled: Column, model: Column) -> Column:
    """'' without fields, the model that read some of them, else 'regex'."""
    by_model = F.exists(F.map_values(fields), lambda f: text(f["source"]).startswith(MODEL))
    return F.when(F.coalesce(F.size(fields), F.lit(0)) <= 0, "").when(F.coalesce(enabled, F.lit(False)) & by_model, F.concat(F.lit(f"{MODEL}:"), text(model))).otherwise("regex")


def read_by_model(body: Column, enabled: Column, answered: Column) -> Column:
    """struct(by, note): whether a stored model's answer counts for a text, or the form's patterns, and why."""
    long = F.length(F.regexp_replace(text(body), r"(?U)\W", "")) >= MODEL_LEAST
    wanted = F.coalesce(enabled, F.lit(False)) & long
    failed = wanted & ~F.coalesce(answered, F.lit(False))
    return F.struct(F.when(wanted & ~failed, MODEL).otherwise("regex").alias("by"), F.when(failed, "the model did not answer").alias("note"))


def kept_source(source: Column, default: str = OCR_TEXT) -> Column:
    """A model's source stays seen; all else is what the page was read by."""
    return F.when(text(source).startswith(MODEL), source).otherwise(default)


# ---------------------------------------------------------------------------------------------------------------
# pages and lines of a scan


def page_kind(page: Column, form: Mapping) -> Column:
    """'start' for a form's first page, 'cont' for one that goes on, null for others."""
    body = F.lower(squeeze(page))
    found = form.get("detect") or {}
    near = lambda keywords: F.size(F.filter(similarity.near_keywords(body, F.array(*map(F.lit, [k.lower() for k in keywords] or [""])), F.lit(84.999)), lambda k: k != ""))
    title = near(found.get("title") or []) > 0 if found.get("title") else F.lit(False)
    marks = near(found.get("continuation") or []) if found.get("continuation") else F.lit(0)
    numbered = F.regexp_count(text(page), F.lit(r"(?m)^\s*\d{1,3}[).]\s*\S+\.[a-zа-яё]{2,}"))
    return F.when(title | detect(page, [form]).isNotNull(), "start").when((marks >= 2) | (numbered >= 3), "cont")


def _plain(c: Column) -> Column:
    return F.translate(F.lower(squeeze(F.regexp_replace(text(c), "_{2,}", " "))), "ё", "е")


def region_extends(value: Column, region: Column) -> Column:
    """A page's value breaks off inside a word that the region goes on with."""
    a, b = _plain(value), _plain(region)
    at = F.instr(b, a)
    following = F.substring(b, at + F.length(a), F.lit(1))
    return (F.length(a) >= 4) & (at > 0) & following.rlike(r"\p{L}") & a.rlike(r"\p{L}$")


def only_form_words(region: Column, labels: Sequence[str], least: int = 3, share: float = 0.6, like: float = 85.0) -> Column:
    """A region's text is mostly words of the printed form, or like them."""
    words = F.transform(F.regexp_extract_all(text(region), F.lit("[А-Яа-яЁёA-Za-z]{3,}"), 0), lambda w: F.lower(w))
    alike = [lambda w, k=k: (w == k) | ((F.abs(F.length(w) - len(k)) <= len(k) * 0.36 + 1) & (similarity.indel_ratio(w, F.lit(k)) >= like)) for k in labels]
    known = F.size(F.filter(words, lambda w: reduce(lambda a, b: a | b, (f(w) for f in alike), F.lit(False))))
    return (F.size(words) >= least) & (known >= share * F.size(words))


def first_line_like(lines: DataFrame, keys: list[str], labels: Sequence[str], y: str = "y0", body: str = "text", below: int = -1) -> DataFrame:
    """keys and the topmost line below `below` that is like one of the labels and not much shorter."""
    low = F.lower(F.col(body))
    near = similarity.near_keywords(low, F.array(*(F.lit(k.lower()) for k in labels)), F.lit(84.999))
    long = F.exists(near, lambda k: F.length(low) >= 0.6 * F.length(k))
    return lines.where(F.col(y) > below).where(long).groupBy(*keys).agg(F.min_by(body, y).alias("line"))


def title_names(title: Column, listed: Column) -> Column:
    """A service's title is one of the listed names, or says what is done with one."""
    done = F.lower(F.regexp_extract(F.trim(text(title)), r"(?iu)^(?:регистрация|перенос|продление|трансфер)\s+домена\s+(\S+)$", 1))
    return present(title) & (F.array_contains(listed, F.lower(F.trim(text(title)))) | ((done != "") & F.array_contains(listed, done)))
