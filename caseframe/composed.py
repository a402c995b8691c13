"""Queries over short texts that are composed from the driver's tables: dates written out in words and lines with check digits follow
from the row's own values, with misread signs in a place given by the key; the SQL computes the answers from the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseframe.functions import dates, zone
from caseframe.queries import query, spread, table
from caseframe.scans import spelled, spelled_sql

MONTHS = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")
ONES = ("первое", "второе", "третье", "четвертое", "пятое", "шестое", "седьмое", "восьмое", "девятое")
TEENS = ("десятое", *(f"{s}надцатое" for s in ("один", "две", "три", "четыр", "пят", "шест", "сем", "восем", "девят")))
DAYS = (*ONES, *TEENS, "двадцатое", *(f"двадцать {d}" for d in ONES), "тридцатое", "тридцать первое")
#: The years 2001 to 2019 after 'две тысячи'.
YEARS = tuple(f"{d[:-1]}его" if d == "третье" else f"{d[:-2]}ого" for d in (*ONES, *TEENS))


def _pick(words: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), number.cast("int"))


@query("""
WITH d AS (SELECT o_orderkey, strftime(o_orderdate + INTERVAL 12 YEAR, '%d.%m.%Y') AS day FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (2, 3) THEN day END AS written, CASE WHEN o_orderkey % 5 <> 4 THEN day END AS worded FROM d
""")
def dates_of_orders_in_words(spark: SparkSession, sf: str) -> DataFrame:
    """Each order's date, twelve years on, in figures, with its month as a word, in words alone, or with a month that there is not."""
    k, day = F.col("o_orderkey"), F.add_months("o_orderdate", 144)
    d, m, y = F.dayofmonth(day), F.month(day), F.year(day)
    figures = lambda month: F.concat_ws(".", F.lpad(d.cast("string"), 2, "0"), F.lpad(month.cast("string"), 2, "0"), y.cast("string"))
    month = _pick(MONTHS, m)
    letter = (
        F.when(k % 5 == 0, F.concat(F.lit("Дано «"), d.cast("string"), F.lit("» "), month, F.lit(" "), y.cast("string"), F.lit(" г.")))
        .when(k % 5 == 1, F.concat(F.lit("Дано "), _pick(DAYS, d), F.lit(" "), month, F.lit(" две тысячи "), _pick(YEARS, y - 2000), F.lit(" года")))
        .when(k % 5 == 2, F.concat(F.lit("Дано "), figures(m), F.lit(", № "), k.cast("string")))
        .when(k % 5 == 3, F.concat(F.lit("Дано "), d.cast("string"), F.lit(" "), month, F.lit(" "), y.cast("string"), F.lit(" года № "), k.cast("string")))
        .otherwise(F.concat(F.lit("Дано "), figures(m + 12)))
    )
    letters = table(spark, sf, "orders").select("o_orderkey", letter.alias("letter"))
    return letters.select("o_orderkey", dates.dmy(dates.parse_date("letter")).alias("written"), dates.dmy(dates.parse_date_words("letter")).alias("worded"))


# ---------------------------------------------------------------------------------------------------------------
# machine-readable zones

#: Digits that are read as letters.
LOOK_ALIKES = ("0124568", "OIZASGB")


def check_digit(field: Column) -> Column:
    """The check digit of digits and fillers: weights 7, 3, 1."""
    digit = lambda i: F.coalesce(F.substring(field, i, F.lit(1)).try_cast("int"), F.lit(0))
    weight = lambda i: F.element_at(F.array(F.lit(7), F.lit(3), F.lit(1)), (i - 1) % 3 + 1)
    return (F.aggregate(F.sequence(F.lit(1), F.length(field)), F.lit(0), lambda s, i: s + digit(i) * weight(i)) % 10).cast("string")


def zones_of(customers: DataFrame) -> DataFrame:
    """c_custkey, n and line: a page of each customer, a line of noise above the two of a zone. In every third page a digit of the
    document number is read as a letter, in every fourth blanks stand in the names, every seventh has lost its second line."""
    k = F.col("c_custkey")
    male = k % 2 == 0
    surname = F.concat(spelled(k, 5, "О"), F.when(male, F.lit("В")).otherwise(F.lit("ВА")))
    patronymic = F.concat(spelled(k * 7 % 1000, 3, "Е"), F.when(male, F.lit("ВИЧ")).otherwise(F.lit("ВНА")))
    names = F.concat(surname, F.lit("<<"), spelled(k * 3 % 100, 2, "А"), F.lit("<"), patronymic)
    latin = F.translate(names, "".join(zone.ALPHABET), "".join(zone.ALPHABET.values()))
    first = F.rpad(F.concat(F.lit("PNRUS"), latin), zone.LENGTH, "<")
    first = F.when(k % 4 == 1, F.concat(F.left(first, F.lit(8)), F.lit("  "), F.lower(F.substring(first, F.lit(9), F.lit(36))))).otherwise(first)

    digits = lambda n, width: F.lpad(n.cast("string"), width, "0")
    short = lambda start, days: F.date_format(F.date_add(F.lit(start).cast("date"), days.cast("int")), "yyMMdd")
    series = digits(k * 7919 % 10000, 4)
    number = F.concat(F.left(series, F.lit(3)), digits(k * 104729 % 1000000, 6))
    born = short("1950-01-01", k * 53 % 12000)
    optional = F.concat(F.right(series, F.lit(1)), short("1998-01-01", k * 37 % 8000), digits(F.col("c_nationkey") * 17 + 100, 3), digits(k % 1000, 3), F.lit("<"))
    checked = lambda field: F.concat(field, check_digit(field))
    parts = customers.select("c_custkey", first.alias("first"), *(checked(c).alias(n) for n, c in (("number", number), ("born", born), ("optional", optional))))
    whole = check_digit(F.concat("number", "born", F.lit("<<<<<<<"), "optional"))
    place = (k % 9 + 1).cast("int")
    read = F.concat(F.substring("number", F.lit(1), place - 1), F.translate(F.substring("number", place, F.lit(1)), *LOOK_ALIKES), F.substring("number", place + 1, F.lit(10)))
    second = F.concat(F.when(k % 3 == 0, read).otherwise(F.col("number")), F.lit("RUS"), "born", F.when(male, F.lit("M")).otherwise(F.lit("F")), F.lit("<<<<<<<"), "optional", whole)
    lines = F.array(F.concat(F.lit("страница "), k.cast("string")), F.col("first"), F.when(k % 7 == 0, F.lit("")).otherwise(second))
    return parts.select("c_custkey", F.posexplode(lines).alias("n", "line"))


_DAY = "strftime(DATE '{}' + CAST(c_custkey * {} % {} AS INTEGER), '%d.%m.%Y')"


@query(f"""
WITH c AS (
  SELECT *, c_custkey % 2 = 0 AS male, lpad(CAST(c_custkey * 7919 % 10000 AS VARCHAR), 4, '0') || ' ' || lpad(CAST(c_custkey * 104729 % 1000000 AS VARCHAR), 6, '0') AS document,
         lpad(CAST(c_nationkey * 17 + 100 AS VARCHAR), 3, '0') || '-' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') AS code FROM customer WHERE c_custkey % 7 <> 0)
SELECT customer.c_custkey, {spelled_sql("c.c_custkey", 5, "О")} || CASE WHEN male THEN 'В' ELSE 'ВА' END AS surname, {spelled_sql("c.c_custkey * 3 % 100", 2, "А")} AS given_name,
       {spelled_sql("c.c_custkey * 7 % 1000", 3, "Е")} || CASE WHEN male THEN 'ВИЧ' ELSE 'ВНА' END AS patronymic, document,
       {_DAY.format("1950-01-01", 53, 12000).replace("c_custkey", "c.c_custkey")} AS born, {_DAY.format("1998-01-01", 37, 8000).replace("c_custkey", "c.c_custkey")} AS issued, code AS department,
       CASE WHEN male THEN 'М' WHEN NOT male THEN 'Ж' END AS sex, CASE WHEN c.c_custkey IS NOT NULL THEN true END AS valid
FROM customer LEFT JOIN c ON customer.c_custkey = c.c_custkey
""")
def zones_of_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's zone, found among the lines of a page and decoded."""
    customers = table(spark, sf, "customer")
    lines = zone.zone_lines(zones_of(spread(customers)), ["c_custkey"], "n", "line")
    found = zone.parse_zones(spread(lines), ["c_custkey"], 2026)
    own = found.select(
        "c_custkey", "surname", "given_name", "patronymic", F.concat_ws(" ", "series", "number").alias("document"), F.col("birth_date").alias("born"), F.col("issue_date").alias("issued"),
        F.col("department_code").alias("department"), "sex", "valid",
    )
    return customers.select("c_custkey").join(own, "c_custkey", "left")
