"""Replies of public registries, fetched elsewhere and stored as text or JSON, parsed to columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseframe.functions.text import first_present, text

#: What a registry says of a free name, and the keys of each attribute, the first that is there counts.
FREE = r"(?im)no entries found|no match for|not found|no data found|^status:\s*free|domain not found|object does not exist"
KEYS = {
    "registrar": ("registrar", "sponsoring registrar", "registrar name"),
    "state": ("state", "domain status", "status"),
    "created": ("created", "creation date", "registered"),
    "paid_till": ("paid-till", "registry expiry date", "registrar registration expiration date", "expiration date", "expires"),
    "free_date": ("free-date",),
    "org": ("org", "registrant organization"),
    "person": ("person",),
}


def parse_whois(c: Column) -> Column:
    """struct(status, registrar, state, ...) of a 'key: value' reply: free, registered, or error for a reply that says neither.
    Repeated keys' distinct values are joined; of a domain status only its first word counts."""
    body = text(c)
    lines = F.filter(F.split(body, "\r?\n"), lambda x: ~x.rlike("^(?:%|#|>>>)") & x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.split_part(x, F.lit(":"), F.lit(1)))).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    pairs = F.filter(pairs, lambda p: p["v"] != "")

    def values(key: str, first_word: bool) -> Column:
        own = F.transform(F.filter(pairs, lambda p: p["k"] == key), lambda p: F.split_part(p["v"], F.lit(" "), F.lit(1)) if first_word else p["v"])
        return F.nullif(F.array_join(F.array_distinct(own), ", "), F.lit(""))

    found = {name: F.coalesce(*(values(k, name == "state" and k != "state") for k in keys)) for name, keys in KEYS.items()}
    named = F.coalesce(values("domain", False), values("domain name", False)).isNotNull()
    free = body.rlike(FREE) & ~body.rlike(r"(?im)^\s*domain(?: name)?:\s*\S")
    status = F.when(free, "free").when(named | found["registrar"].isNotNull(), "registered").otherwise("error")
    return F.struct(status.alias("status"), *(F.when(status != "free", v).alias(k) for k, v in found.items()))


def parse_rdap(c: Column, code: Column) -> Column:
    """struct(status, registrar, state, created, paid_till) of a JSON reply; HTTP status 404 is a free name."""
    events = F.from_json(F.get_json_object(c, "$.events"), "array<struct<eventAction:string,eventDate:string>>")
    event = lambda name: F.get(F.filter(events, lambda e: e["eventAction"] == name), F.lit(0))["eventDate"]
    entities = F.from_json(F.get_json_object(c, "$.entities"), "array<struct<roles:array<string>,vcardArray:string>>")
    registrar = F.get(F.filter(entities, lambda e: F.array_contains(e["roles"], "registrar")), F.lit(0))["vcardArray"]
    name = F.regexp_extract(text(registrar), r'\["fn",[^\]]*?"text",\s*"([^"]*)"', 1)
    status = F.when(code == 404, "free").when((code == 200) & F.get_json_object(c, "$.ldhName").isNotNull(), "registered").otherwise("error")
    states = F.from_json(F.get_json_object(c, "$.status"), "array<string>")
    return F.struct(status.alias("status"), F.nullif(name, F.lit("")).alias("registrar"), F.array_join(states, ", ").alias("state"), event("registration").alias("created"), event("expiration").alias("paid_till"))


def query_kind(c: Column) -> Column:
    """struct(kind, value) of what someone typed to find an account: a number, an address or login, a domain name, or neither."""
    v = F.trim(text(c))
    # How a number is written in links, headings and letters.
    patterns = (r"user_id=(\d+)", r"/user/(\d+)(?:/|$|\?)", r"#\s*(\d{3,})", r"(?iu)пользователя\s+(\d{3,})", r"(?iU)договор\w*\s*(?:№|N|No)?\s*(\d{3,})", r"^\s*(?:№\s*)?(\d{3,})\s*$")
    number = F.coalesce(*(F.nullif(F.regexp_extract(v, p, 1), F.lit("")) for p in patterns))
    address = F.btrim(F.split_part(F.btrim(v, F.lit("<> \t\"'")), F.lit(" "), F.lit(1)), F.lit("<> \t\"'"))
    bare = F.rtrim(F.split_part(F.regexp_replace(F.lower(v), "^[a-z]+://", ""), F.lit("/"), F.lit(1)), F.lit("."))
    domain = ~v.rlike(r"(?U)[\s,;]") & bare.rlike(r"\.(?:[a-zа-яё]{2,}|xn--[a-z0-9\-]+)$")
    return (
        F.when(number.isNotNull(), F.struct(F.lit("id").alias("kind"), number.alias("value")))
        .when(v.contains("@"), F.struct(F.lit("login").alias("kind"), address.alias("value")))
        .when(domain, F.struct(F.lit("domain").alias("kind"), bare.alias("value")))
        .when(v.rlike(r"^[A-Za-z0-9_.\-]{3,64}$"), F.struct(F.lit("login").alias("kind"), v.alias("value")))
        .otherwise(F.struct(F.lit("").alias("kind"), v.alias("value")))
    )


def owner_records(records: DataFrame, requested: DataFrame) -> DataFrame:
    """For each case the record of its first name that has one. records: domain and record; requested: case_id, pos, domain."""
    found = requested.join(records, "domain").groupBy("case_id").agg(F.min_by(F.struct("domain", "record"), "pos").alias("f"))
    return found.select("case_id", "f.domain", "f.record")


def cached_answers(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with their stored answers, requests that have none). Both have `payload`; answers are kept by its digest."""
    keyed = requests.withColumn("digest", F.sha2("payload", 256))
    stored = cache.select("digest", "answer").dropDuplicates(["digest"])
    return keyed.join(stored, "digest"), keyed.join(stored.select("digest"), "digest", "left_anti")


def first_value(*cs: Column) -> Column:
    return first_present(*cs)
