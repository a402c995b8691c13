"""Notes on a whole list of domain names: what only shows when all its lookups lie side by side.

lookups: case_id, pos, domain, status (found, not_found, error), kind (person, org, other), contacts (the kind of contacts as the registry
calls it), account, holder, passport, passport_place, passport_date, service_status, verdict, error, error_code, identity (how an
identification stands, null: none asked for), whois_error. Missing values are null or empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseframe.functions.text import digits, first_present, fold, present, text

NOTE = "case_id {}, place int, note string, subject string, counts array<struct<value:string,n:bigint>>, domains array<string>"
#: How an active service's status begins, the state of a deleted one, how services are listed in an error.
ACTIVE, DELETED, SERVICE, NONE = "Активна", "D", r"\d+ \((\w+|\?)\)", "—"


def _ordered(rows: Column) -> Column:
    """Domains of collected struct(pos, domain), in the list's order."""
    return F.transform(F.array_sort(rows), lambda x: x["domain"])


def _counted(rows: DataFrame, keys: list[str], value: Column, order: Column | None = None) -> DataFrame:
    """keys and counts: each value with its number of rows, the most frequent first (or by `order`), then by value."""
    each = rows.withColumn("__v", value).groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("n"), (F.min(order) if order is not None else -F.count(F.lit(1))).alias("o"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", F.col("__v").alias("value"), "n"))), lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias("counts"))


def _note(rows: DataFrame, place: int, note: str) -> DataFrame:
    have = rows.columns
    none = {"subject": F.lit(None).cast("string"), "counts": F.array().cast("array<struct<value:string,n:bigint>>"), "domains": F.array().cast("array<string>")}
    return rows.select("case_id", F.lit(place).alias("place"), F.lit(note).alias("note"), *(F.col(c) if c in have else v.alias(c) for c, v in none.items()))


def owner_of(lookups: DataFrame) -> Column:
    """What tells a list's owners apart: kind with passport digits or, without a passport, the folded name."""
    return F.concat_ws("|", text("kind"), first_present(digits("passport"), fold("holder")))


def list_notes(lookups: DataFrame) -> DataFrame:
    """case_id, place, note, subject, counts and domains, a row for each remark on a case's list:

    services (statuses of found names, where one isn't active), unverified (found names, none with a verdict), owners (an account whose names
    have several, in the list's order), passport (one passport whose place or date of issue is written in several ways, with the names that
    have a rarer one), unread (names whose public record gave an error), ambiguous (several services and no active one, with the
    names all of whose services are deleted), identity (how identifications stand, with the names that don't match), contacts (kinds
    other than persons and organisations). A list is bounded by its case; cases are many, and every note is one or two
    aggregates over them."""
    own = lookups.where(F.col("case_id").isNotNull())
    found = own.where("status = 'found'")
    services = F.coalesce(F.nullif(text("service_status"), F.lit("")), F.lit(NONE))
    odd = found.where(~services.startswith(ACTIVE)).select("case_id").distinct()
    out = [_note(_counted(found, ["case_id"], services).join(odd, "case_id", "left_semi"), 1, "services")]

    checked = found.groupBy("case_id").agg(F.max(present("verdict")).alias("some"), F.count(F.lit(1)).alias("n"))
    out.append(_note(checked.where(~F.col("some")).select("case_id", F.array(F.struct(F.lit("found").alias("value"), "n")).alias("counts")), 2, "unverified"))

    account = F.coalesce(F.nullif(text("account"), F.lit("")), F.lit(NONE))
    owners = found.withColumn("subject", account).withColumn("owner", owner_of(found)).groupBy("case_id", "subject", "owner").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.min_by(text("holder"), "pos").alias("holder"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("first", "holder", "n"))), lambda x: F.struct(F.when(x["holder"] == "", NONE).otherwise(x["holder"]).alias("value"), x["n"].alias("n")))
    out.append(_note(owners.groupBy("case_id", "subject").agg(listed.alias("counts")).where(F.size("counts") > 1), 3, "owners"))

    papers = found.where("kind = 'person'").select("case_id", "pos", "domain", digits("passport").alias("subject"), F.trim(text("passport_place")).alias("where"), F.trim(text("passport_date")).alias("when")).where("subject <> ''")
    one = ["case_id", "subject"]
    for c in ("where", "when"):
        papers = papers.withColumn(f"n_{c}", F.count(F.lit(1)).over(W.partitionBy(*one, c)))
        papers = papers.withColumn(f"most_{c}", F.max(f"n_{c}").over(W.partitionBy(*one)))
    rare = (F.col("n_where") < F.col("most_where")) | (F.col("n_when") < F.col("most_when"))
    both = papers.groupBy(*one).agg(F.countDistinct("where").alias("places"), F.countDistinct("when").alias("dates"), F.count(F.lit(1)).alias("n"), _ordered(F.collect_list(F.when(rare, F.struct("pos", "domain")))).alias("domains"))
    out.append(_note(both.where("places > 1 OR dates > 1").select(*one, F.array(F.struct(F.lit("names").alias("value"), "n")).alias("counts"), "domains"), 4, "passport"))

    unread = own.where(present("whois_error"))
    names = unread.groupBy("case_id").agg(_ordered(F.collect_list(F.struct("pos", "domain"))).alias("domains"))
    out.append(_note(_counted(unread, ["case_id"], text("whois_error")).join(names, "case_id"), 6, "unread"))

    several = own.where("error_code = 'ambiguous'").withColumn("states", F.regexp_extract_all(text("error"), F.lit(SERVICE), 1))
    gone = (F.size("states") > 0) & F.forall("states", lambda s: s == DELETED)
    ambiguous = several.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), _ordered(F.collect_list(F.when(gone, F.struct("pos", "domain")))).alias("domains"))
    out.append(_note(ambiguous.select("case_id", F.array(F.struct(F.lit("ambiguous").alias("value"), "n")).alias("counts"), "domains"), 7, "ambiguous"))

    asked = found.where(present("identity"))
    differ = asked.groupBy("case_id").agg(_ordered(F.collect_list(F.when(F.col("identity") == "mismatch", F.struct("pos", "domain")))).alias("domains"))
    out.append(_note(_counted(asked, ["case_id"], F.col("identity")).join(differ, "case_id"), 8, "identity"))

    other = found.where(~text("kind").isin("person", "org"))
    out.append(_note(_counted(other, ["case_id"], F.coalesce(F.nullif(text("contacts"), F.lit("")), F.lit("?")), F.col("pos")), 9, "contacts"))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole
