"""Queries on the driver's tables, one for each operator pattern, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseframe.functions import checksums, dates, issuer, similarity, text
from caseframe.operators import grouping, matching, sequences, votes
from caseframe.plans import rules
from caseframe.sources import html

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows in some parts a core: a small file is read by one task, however much work there is for each of its rows."""
    return rows.repartition(max(16, 3 * rows.sparkSession.sparkContext.defaultParallelism))


# ---------------------------------------------------------------------------------------------------------------
# extraction and scalars

EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+"


@query(rf"""
SELECT doc_id, pos, email FROM (
  SELECT doc_id, unnest(l) AS email, generate_subscripts(l, 1) - 1 AS pos FROM (
    SELECT doc_id, list_transform(regexp_extract_all(text, '{EMAIL}'), lambda x: lower(x)) AS l FROM documents))
""")
def extract_emails(spark: SparkSession, sf: str) -> DataFrame:
    found = F.transform(F.regexp_extract_all("text", F.lit(EMAIL), 0), F.lower)
    return table(spark, sf, "documents").select("doc_id", F.posexplode(found).alias("pos", "email")).select("doc_id", F.col("pos").cast("long").alias("pos"), "email")


@query(rf"""
SELECT lang, regexp_replace(email, '^.*@', '') AS host, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (
  SELECT doc_id, lang, unnest(list_transform(regexp_extract_all(text, '{EMAIL}'), lambda x: lower(x))) AS email FROM documents)
GROUP BY ALL
""")
def email_domains_per_lang(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "documents").select("doc_id", "lang", F.explode(F.transform(F.regexp_extract_all("text", F.lit(EMAIL), 0), F.lower)).alias("email"))
    return found.groupBy("lang", F.regexp_replace("email", "^.*@", "").alias("host")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


_LUHN = "list_sum(list_transform(range(1, len(number) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(number)[i] AS INT) ELSE CAST(reverse(number)[i] AS INT) * 2 - CASE WHEN CAST(reverse(number)[i] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"


@query(f"""
SELECT doc_id, number, {_LUHN} AS valid FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{{12,19}}')) AS number FROM documents)
""")
def long_digit_runs_luhn(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]{12,19}"), 0)).alias("number"))
    return found.withColumn("valid", checksums.luhn_valid("number"))


_D = "CAST(n[{}] AS INT)"


def _weights(ws: tuple[int, ...], digit: int) -> str:
    return "(" + " + ".join(f"{w} * {_D.format(i + 1)}" for i, w in enumerate(ws)) + f") % 11 % 10 = {_D.format(digit)}"


@query(f"""
SELECT c_custkey, n AS number, {_weights(checksums.TAX_10, 10)} AS valid FROM (SELECT c_custkey, lpad(CAST(c_custkey * 7919 % 10000000000 AS VARCHAR), 10, '0') AS n FROM customer)
UNION ALL
SELECT c_custkey, n, {_weights(checksums.TAX_12_FIRST, 11)} AND {_weights(checksums.TAX_12_SECOND, 12)} FROM (SELECT c_custkey, lpad(CAST(c_custkey * 104729 AS VARCHAR), 12, '0') AS n FROM customer)
""")
def inn_style_checksum(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    ten = F.lpad((F.col("c_custkey") * 7919 % 10000000000).cast("string"), 10, "0")
    twelve = F.lpad((F.col("c_custkey") * 104729).cast("string"), 12, "0")
    both = c.select("c_custkey", F.explode(F.array(ten, twelve)).alias("number"))
    return both.withColumn("valid", checksums.tax_number_valid("number"))


@query("""
SELECT p_partkey, list_sum(list_transform(range(1, len(s) + 1), lambda i: (CASE WHEN s[i] BETWEEN '0' AND '9' THEN ascii(s[i]) - 48 WHEN s[i] BETWEEN 'A' AND 'Z' THEN ascii(s[i]) - 55 ELSE 0 END) * [7, 3, 1][(i - 1) % 3 + 1])) % 10 AS digit
FROM (SELECT p_partkey, upper(replace(p_name, ' ', '<')) AS s FROM part)
""")
def mrz_check_digit(spark: SparkSession, sf: str) -> DataFrame:
    zone = F.upper(F.replace("p_name", F.lit(" "), F.lit("<")))
    return table(spark, sf, "part").select("p_partkey", checksums.zone_check_digit(zone).cast("long").alias("digit"))


@query(r"""
SELECT host, count(*) AS pages FROM (SELECT regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\.([^.]+\.)', '\1') AS host FROM pages) GROUP BY host
""")
def url_hosts_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").groupBy(text.host_of_url("url").alias("host")).agg(F.count(F.lit(1)).alias("pages"))


@query(r"""
SELECT event_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) AS k, CASE WHEN props IS NULL THEN '' WHEN CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) = user_id % 10 THEN 'ok' ELSE 'fail' END AS status FROM events
""")
def json_path_compare(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    compared = matching.compare_attributes(table(spark, sf, "events").withColumn("k", k).withColumn("u", (F.col("user_id") % 10).cast("string")), {"k": ("k", "u", "digits")})
    return compared.select("event_id", F.col("k").cast("int").alias("k"), F.col("compared")[0]["status"].alias("status"))


@query(r"""
SELECT doc_id, md5(trim(regexp_replace(replace(upper(text), 'Ё', 'Е'), '\s+', ' ', 'g'), ' .,')) AS folded,
       md5(trim(regexp_replace(replace(lower(text), 'ё', 'е'), '[^0-9a-zа-я]+', ' ', 'g'))) AS words FROM (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', ' ', 'g') AS text FROM documents)
""")
def text_normalize_fold(spark: SparkSession, sf: str) -> DataFrame:
    ascii_only = F.regexp_replace("text", r"[^\x00-\x7F]", " ")  # upper() of ß and the like differs between engines
    return table(spark, sf, "documents").select("doc_id", F.md5(text.fold(ascii_only)).alias("folded"), F.md5(text.word_key(ascii_only)).alias("words"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS written, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS parsed FROM orders
""")
def date_text_parse(spark: SparkSession, sf: str) -> DataFrame:
    day = F.date_format("o_orderdate", "dd.MM.yyyy")
    months = F.array(*map(F.lit, ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")))
    worded = F.concat_ws(" ", F.dayofmonth("o_orderdate"), F.get(months, F.month("o_orderdate") - 1), F.year("o_orderdate"), F.lit("года"))
    wrong = F.concat(F.lit("31.02."), F.year("o_orderdate"), F.lit(" и "), day)  # a wrong first date hides the next
    styles = F.when(F.col("o_orderkey") % 7 == 0, wrong).when(F.col("o_orderkey") % 7 == 1, worded).when(F.col("o_orderkey") % 7 == 2, F.date_format("o_orderdate", "dd/MM-yyyy")).otherwise(F.concat(F.lit("от "), day, F.lit(" г.")))
    return table(spark, sf, "orders").select("o_orderkey", day.alias("written"), F.date_format(dates.parse_date(styles), "yyyy-MM-dd").alias("parsed"))


# Rows of the table of common subsequences, one letter of a after the other; d is the row's last value of each letter of b.
_RATIO = "CASE WHEN {a} = {b} THEN 100.0 ELSE 200.0 * {lcs} / (length({a}) + length({b})) END"


@query(f"""
WITH RECURSIVE p AS (
  SELECT n_nationkey, r_regionkey, n_name AS a, r_name AS b FROM nation CROSS JOIN region),
t AS (
  SELECT n_nationkey, r_regionkey, a, b, 0 AS i, 0 AS j, list_transform(range(0, length(b) + 1), lambda x: 0) AS above, CAST([] AS BIGINT[]) AS done FROM p
  UNION ALL
  SELECT n_nationkey, r_regionkey, a, b, CASE WHEN j = length(b) THEN i + 1 ELSE i END, CASE WHEN j = length(b) THEN 0 ELSE j + 1 END,
    CASE WHEN j = length(b) THEN list_concat(CASE WHEN i = 0 THEN above ELSE done END, CAST([] AS BIGINT[])) ELSE above END,
    CASE WHEN j = length(b) THEN CAST([0] AS BIGINT[])
      ELSE list_append(done, CASE WHEN substr(a, i, 1) = substr(b, j + 1, 1) THEN above[j + 1] + 1 ELSE greatest(above[j + 2], done[j + 1]) END) END
  FROM (SELECT * REPLACE (CASE WHEN i = 0 THEN length(b) ELSE j END AS j) FROM t) WHERE i < length(a) OR j < length(b)),
l AS (SELECT n_nationkey, r_regionkey, a, b, done[len(done)] AS lcs FROM t WHERE i = length(a) AND j = length(b))
SELECT n_nationkey, r_regionkey, round({_RATIO.format(a="a", b="b", lcs="lcs")}, 6) AS ratio FROM l
""")
def indel_ratio_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each nation's name with every region's (a list of a few names, one value of a scalar subquery)."""
    regions = table(spark, sf, "region").agg(F.collect_list(F.struct("r_regionkey", "r_name"))).scalar()
    pairs = table(spark, sf, "nation").select("n_nationkey", "n_name", F.inline(regions))
    return pairs.select("n_nationkey", "r_regionkey", F.round(similarity.indel_ratio("n_name", "r_name"), 6).alias("ratio"))


@query("""
WITH p AS (
  SELECT p_partkey, c_custkey, list_distinct(string_split(p_name, ' ')) AS x, list_distinct(string_split(c_name, '#')) AS y
  FROM part JOIN customer ON p_partkey = c_custkey)
SELECT p_partkey, c_custkey, len(list_intersect(x, y)) AS common, len(x) AS left_words, len(y) AS right_words FROM p
""")
def common_words(spark: SparkSession, sf: str) -> DataFrame:
    """The word sets behind the token-set ratio, for parts and customers of one number."""
    p = table(spark, sf, "part").select("p_partkey", F.array_distinct(F.split("p_name", " ")).alias("x"))
    c = table(spark, sf, "customer").select("c_custkey", F.array_distinct(F.split("c_name", "#")).alias("y"))
    sizes = {"common": F.size(F.array_intersect("x", "y")), "left_words": F.size("x"), "right_words": F.size("y")}
    return p.join(c, F.col("p_partkey") == F.col("c_custkey")).select("p_partkey", "c_custkey", *(n.cast("long").alias(k) for k, n in sizes.items()))


# A side whose words are all among the other's has the full score.
@query("""
WITH w AS (
  SELECT n_nationkey, list_distinct(string_split(n_name || ' nation of ' || r_name, ' ')) AS x, list_distinct(string_split(r_name || ' of nation ' || n_name || ' again', ' ')) AS y
  FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT n_nationkey, CASE WHEN len(list_intersect(x, y)) = least(len(x), len(y)) THEN 100.0 END AS score FROM w
""")
def token_set_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Each nation's name, with its key words in another order and some more, against itself."""
    n = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", F.round(similarity.token_set_ratio(F.concat_ws(" ", "n_name", F.lit("nation of"), "r_name"), F.concat_ws(" ", "r_name", F.lit("of nation"), "n_name", F.lit("again"))), 6).alias("score"))


# ---------------------------------------------------------------------------------------------------------------
# votes

@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS votes, avg(value) AS mean FROM events GROUP BY ALL),
t AS (SELECT *, sum(votes) OVER (PARTITION BY user_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, mean DESC, event_type) AS rn FROM c)
SELECT user_id, event_type, votes, round(votes / a, 6) AS share, round(least(0.95, mean * (0.6 + 0.4 * votes / a)), 6) AS confidence FROM t WHERE rn = 1
""")
def majority_vote_event_type(spark: SparkSession, sf: str) -> DataFrame:
    won = votes.majority_vote(table(spark, sf, "events"), ["user_id"], "event_type", "value")
    return won.select("user_id", "event_type", "votes", F.round("share", 6).alias("share"), F.round("confidence", 6).alias("confidence"))


@query("""
WITH c AS (SELECT user_id, event_type, sum(greatest(value * CASE WHEN event_type = 'purchase' THEN 3 ELSE 1 END, 1.0)) AS w FROM events GROUP BY ALL),
t AS (SELECT *, sum(w) OVER (PARTITION BY user_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, event_type) AS rn FROM c)
SELECT user_id, event_type, round(w, 4) AS weight, round(w / a, 6) AS share FROM t WHERE rn = 1
""")
def weighted_vote(spark: SparkSession, sf: str) -> DataFrame:
    weight = F.col("value") * F.when(F.col("event_type") == "purchase", 3).otherwise(1)
    won = votes.weighted_vote(table(spark, sf, "events"), ["user_id"], "event_type", weight)
    return won.select("user_id", "event_type", F.round("weight", 4).alias("weight"), F.round("share", 6).alias("share"))


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS seen FROM events GROUP BY ALL),
r AS (SELECT user_id, list(event_type ORDER BY n DESC, seen) AS l, list(n ORDER BY n DESC, seen) AS ns FROM c GROUP BY user_id)
SELECT user_id, l[1] AS best, array_to_string(l, ',') AS alternatives, round(CASE WHEN len(ns) > 1 AND ns[1] = ns[2] THEN 0.45 ELSE least(0.95, 0.6 + 0.1 * ns[1]) END, 6) AS confidence FROM r
""")
def frequency_ranked_alternatives(spark: SparkSession, sf: str) -> DataFrame:
    ranked = votes.ranked_alternatives(table(spark, sf, "events"), ["user_id"], "event_type", "event_id")
    return ranked.select("user_id", "best", F.concat_ws(",", "alternatives").alias("alternatives"), F.round("confidence", 6).alias("confidence"))


@query("""
WITH r AS (SELECT user_id, event_type, CAST(floor(value) AS INT) % 5 AS item FROM events),
t AS (SELECT user_id, count(DISTINCT event_type) AS readings FROM r GROUP BY 1), v AS (SELECT user_id, item, count(DISTINCT event_type) AS votes FROM r GROUP BY ALL)
SELECT user_id, item, votes, readings, votes * 2 > readings AS majority FROM v JOIN t USING (user_id)
""")
def list_reading_vote(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "events").withColumn("item", F.floor("value").cast("int") % 5)
    return votes.list_vote(items, ["user_id"], "event_type", "item").select("user_id", "item", "votes", "readings", "majority")


# ---------------------------------------------------------------------------------------------------------------
# order within a key

@query("""
SELECT user_id, event_type, round(value, 4) AS value, attempts, history FROM (
  SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value, count(*) AS attempts, string_agg(event_type, ',' ORDER BY ts, event_id) AS history FROM events GROUP BY user_id)
""")
def latest_attempt_with_history(spark: SparkSession, sf: str) -> DataFrame:
    out = sequences.latest_with_history(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], ["event_type", "value"], "event_type")
    return out.select("user_id", "event_type", F.round("value", 4).alias("value"), "attempts", F.concat_ws(",", "history").alias("history"))


@query("""
SELECT user_id, session, count(*) AS n, min(event_id) AS first_event FROM (
  SELECT user_id, event_id, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM events)
WHERE session > 0 GROUP BY ALL
""")
def sessionize_by_marker(spark: SparkSession, sf: str) -> DataFrame:
    s = sequences.sessions_by_marker(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup")
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("""
SELECT event_id, coalesce(bool_or(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS customer FROM events
""")
def fill_forward_after_first(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.after_first(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", "customer").select("event_id", "customer")


@query("""
SELECT event_id, CASE WHEN coalesce(bool_or(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'skipped' ELSE event_type END AS result FROM events
""")
def stop_after_error(spark: SparkSession, sf: str) -> DataFrame:
    e = sequences.skip_after_stop(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")
    return e.select("event_id", F.when(F.col("skipped"), "skipped").otherwise(F.col("event_type")).alias("result"))


@query("""
SELECT user_id, cluster, count(*) AS n, round(min(value), 4) AS low, round(max(value), 4) AS high FROM (
  SELECT user_id, value, sum(CASE WHEN gap > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY value, event_id ROWS UNBOUNDED PRECEDING) AS cluster FROM (
    SELECT user_id, event_id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY value, event_id) AS gap FROM events)) GROUP BY ALL
""")
def gap_clusters(spark: SparkSession, sf: str) -> DataFrame:
    c = sequences.gap_clusters(table(spark, sf, "events"), ["user_id"], ["value", "event_id"], "value", 5.0)
    return c.groupBy("user_id", "cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("value"), 4).alias("low"), F.round(F.max("value"), 4).alias("high"))


@query("""
SELECT user_id, island, count(*) AS n, min(event_id) AS first_event FROM (
  SELECT user_id, event_id, good, sum(CASE WHEN good AND NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT user_id, event_id, ts, event_type IN ('view', 'click') AS good, lag(event_type IN ('view', 'click')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events))
WHERE good GROUP BY ALL
""")
def list_islands(spark: SparkSession, sf: str) -> DataFrame:
    i = sequences.islands(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type").isin("view", "click"))
    return i.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("""
SELECT conv_id, turn, length(t) AS left_length, length(nt) AS right_length FROM (
  SELECT conv_id, turn, role, text AS t, lead(text) OVER w AS nt, lead(role) OVER w AS nr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant'
""")
def adjacent_pairs(spark: SparkSession, sf: str) -> DataFrame:
    p = sequences.adjacent_pairs(table(spark, sf, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user", F.col("role") == "assistant", "text")
    return p.select("conv_id", "turn", F.length("left").cast("long").alias("left_length"), F.length("right").cast("long").alias("right_length"))


@query("SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS text FROM conversations GROUP BY conv_id")
def concat_ordered_text(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.text_in_order(table(spark, sf, "conversations"), ["conv_id"], "turn", "text", "\n").withColumn("text", F.md5("text"))


@query("""
SELECT l_partkey, place, l_orderkey, l_linenumber, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS place FROM lineitem) WHERE place <= 3
""")
def top_k_per_group(spark: SparkSession, sf: str) -> DataFrame:
    top = sequences.top_of_each(table(spark, sf, "lineitem"), ["l_partkey"], [F.desc("l_quantity"), F.asc("l_orderkey"), F.asc("l_linenumber")], 3)
    return top.select("l_partkey", "place", "l_orderkey", "l_linenumber", "l_quantity")


@query("""
SELECT user_id, coalesce(arg_min(event_type, event_id) FILTER (value >= 50), arg_min(event_type, (-value, event_id))) AS event_type FROM events GROUP BY user_id
""")
def first_good_reading(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.first_good_else_best(table(spark, sf, "events"), ["user_id"], "event_id", "value", 50.0, "event_type")


# ---------------------------------------------------------------------------------------------------------------
# matching

@query("""
SELECT p_brand, p_name, arg_min(o, (e, o)) AS nearest, min(e) AS edits FROM (
  SELECT DISTINCT a.p_brand, a.p_name, b.p_name AS o, levenshtein(a.p_name, b.p_name) AS e FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_name <> b.p_name AND abs(length(a.p_name) - length(b.p_name)) <= 2)
WHERE e <= 2 GROUP BY ALL
""")
def near_name_best_match(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_brand", "p_name").distinct()
    return matching.nearest_by_edits(p, p, ["p_brand"], "p_name", "p_name", 2)


@query("""
WITH w AS (SELECT n_nationkey, n_name AS v, CASE WHEN n_nationkey % 3 = 0 THEN left(n_name, 3) || '~' || substr(n_name, 5) ELSE n_name END AS word FROM nation),
c AS (SELECT word, v2, e, count(*) FILTER (e = m) OVER (PARTITION BY word) AS k, m FROM (
  SELECT DISTINCT w.word, n.n_name AS v2, levenshtein(w.word, n.n_name) AS e, min(levenshtein(w.word, n.n_name)) OVER (PARTITION BY w.word) AS m FROM w JOIN nation n
  ON abs(length(w.word) - length(n.n_name)) <= CASE WHEN length(w.word) < 9 THEN 1 ELSE 2 END AND levenshtein(w.word, n.n_name) <= CASE WHEN length(w.word) < 9 THEN 1 ELSE 2 END
  WHERE length(w.word) >= 5 AND w.word NOT IN (SELECT n_name FROM nation)))
SELECT n_nationkey, w.word, coalesce(c.v2, w.word) AS repaired FROM w LEFT JOIN c ON w.word = c.word AND c.e = c.m AND c.k = 1
""")
def vocabulary_repair(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    seeded = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.left("n_name", F.lit(3)), F.lit("~"), F.expr("substring(n_name, 5)"))).otherwise(F.col("n_name"))
    return issuer.repair_words(n.select("n_nationkey", seeded.alias("word")), n.select(F.col("n_name").alias("word"))).select("n_nationkey", "word", "repaired")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def anti_join_foreign_items(spark: SparkSession, sf: str) -> DataFrame:
    good = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return matching.missing_items(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), good, ["o_custkey"])


@query("""
SELECT c_custkey, p.first_order FROM customer LEFT JOIN (SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS first_order FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) p ON c_custkey = o_custkey
""")
def semi_join_previous(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey")
    return matching.first_match(table(spark, sf, "customer").select("c_custkey"), done, ["c_custkey"], "o_orderkey", "o_orderkey", "first_order")


_SAME = "CASE WHEN {0} IS NULL OR {1} IS NULL THEN '' WHEN {0} = {1} THEN 'ok' ELSE 'fail' END AS {2}"
_DIGITS = "regexp_replace({}, '[^0-9]', '', 'g')"


@query(f"""
SELECT c_custkey, s_suppkey, {_SAME.format(_DIGITS.format("c_name"), _DIGITS.format("s_name"), "number")}, {_SAME.format("c_nationkey", "s_nationkey", "nation")},
  {_SAME.format("round(abs(c_acctbal))", "round(abs(s_acctbal))", "balance")} FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey
""")
def attribute_compare_map(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's record against the supplier of the same number, '' where there is none."""
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    pairs = c.join(s, F.col("c_custkey") == F.col("s_suppkey"), "left")
    pairs = pairs.withColumn("a", F.round("c_acctbal").cast("long").cast("string")).withColumn("b", F.round("s_acctbal").cast("long").cast("string"))
    m = matching.compare_attributes(pairs, {"number": ("c_name", "s_name", "digits"), "nation": ("c_nationkey", "s_nationkey", "digits"), "balance": ("a", "b", "digits")})
    return m.select("c_custkey", "s_suppkey", *(F.col("compared")[i]["status"].alias(n) for i, n in enumerate(("number", "nation", "balance"))))


@query("""
SELECT doc_id, a.toxic AS before, b.toxic AS after FROM (SELECT doc_id, toxic FROM labels) a
FULL JOIN (SELECT doc_id, CAST(n_chars > 3000 AS INT) AS toxic FROM documents) b USING (doc_id) WHERE a.toxic IS DISTINCT FROM b.toxic
""")
def full_outer_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Labels against those that a rule gives."""
    a = table(spark, sf, "labels").select("doc_id", "toxic")
    b = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") > 3000).cast("int").alias("toxic"))
    return matching.difference(a, b, ["doc_id"], "toxic")


@query("""
WITH o AS (SELECT o_custkey, o_orderpriority AS service, max(o_orderstatus = 'O') AS active FROM orders GROUP BY ALL),
c AS (SELECT o_custkey, count(*) FILTER (active) AS n, count(*) AS k, min(service) FILTER (active) AS one, min(service) AS least FROM o GROUP BY 1)
SELECT o_custkey, CASE WHEN n = 1 THEN 'active' WHEN n = 0 AND k = 1 THEN 'inactive' ELSE 'ambiguous' END AS state, CASE WHEN n = 1 THEN one WHEN n = 0 AND k = 1 THEN least END AS picked FROM c
""")
def service_pick_one_active(spark: SparkSession, sf: str) -> DataFrame:
    return matching.pick_active(table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", F.col("o_orderstatus") == "O")


# ---------------------------------------------------------------------------------------------------------------
# summaries and decisions

@query("""
WITH c AS (SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT *, max(n) OVER (PARTITION BY l_partkey) AS most FROM c)
SELECT l_partkey, l_returnflag, n, most FROM m WHERE n < most
""")
def inconsistent_attributes(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.rare_values(table(spark, sf, "lineitem"), ["l_partkey"], "l_returnflag").select("l_partkey", "l_returnflag", "n", "most")


@query("SELECT o_custkey, count(DISTINCT o_orderstatus) AS statuses FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def groups_with_multiple_admins(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.several_values(table(spark, sf, "orders"), ["o_custkey"], F.col("o_orderstatus"), "statuses")


@query("""
WITH s AS (SELECT d.source, CASE WHEN l.doc_id IS NULL THEN 'not_found' WHEN l.quality = 0 THEN 'error' ELSE 'found' END AS status FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT source, count(*) FILTER (status = 'found') AS found, count(*) FILTER (status = 'not_found') AS missing, count(*) FILTER (status = 'error') AS errors,
  CASE WHEN count(*) FILTER (status = 'not_found') > 0 THEN 'fail' WHEN count(*) FILTER (status = 'error') > 0 THEN 'review' ELSE 'ok' END AS result FROM s GROUP BY source
""")
def found_missing_summary(spark: SparkSession, sf: str) -> DataFrame:
    d, l = table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels").select("doc_id", "quality")  # noqa: E741
    status = F.when(F.col("quality").isNull(), "not_found").when(F.col("quality") == 0, "error").otherwise("found")
    return grouping.found_summary(d.join(l, "doc_id", "left").withColumn("status", status), ["source"], "status")


@query("""
WITH p AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'free' ELSE 'not_found' END WHEN o_orderstatus = 'F' AND o_orderkey % 11 = 0 THEN 'error'
  ELSE CASE o_orderpriority[1] WHEN '1' THEN 'mismatch' WHEN '2' THEN 'review' WHEN '3' THEN 'warn' WHEN '4' THEN 'info' ELSE 'ok' END END AS problem FROM orders)
SELECT o_orderkey, problem, row_number() OVER (ORDER BY list_position(['free', 'mismatch', 'not_found', 'error', 'review', 'warn', 'info', 'unchecked', 'ok'], problem), o_orderkey) AS place FROM p
""")
def severity_rank_sort(spark: SparkSession, sf: str) -> DataFrame:
    """Every order with its place in the problem order."""
    o = table(spark, sf, "orders")
    lookup = F.when(F.col("o_orderstatus") == "P", "not_found").when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 11 == 0), "failed").otherwise("found")
    registry = F.when(F.col("o_orderkey") % 2 == 0, "free").otherwise("taken")
    verdict = F.get(F.array(*map(F.lit, ("fail", "review", "warn", "info", "ok"))), F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    return grouping.placed(o.select("o_orderkey", grouping.problem(lookup, registry, verdict).alias("problem")), "problem", "o_orderkey")


@query("""
SELECT event_type, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
""")
def status_histogram(spark: SparkSession, sf: str) -> DataFrame:
    h = grouping.histogram(table(spark, sf, "events"), "event_type")
    return h.select("event_type", "n", F.round(F.col("n") / h.agg(F.sum("n")).scalar(), 6).alias("share"))


@query("""
SELECT user_id, arg_min(event_type, (-n, event_type)) AS event_type, max(n) AS n FROM (SELECT user_id, event_type, count(*) FILTER (length(coalesce(props, '')) > 0) AS n FROM events WHERE event_type <> 'error' GROUP BY ALL) GROUP BY 1
""")
def fullest_group(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where("event_type <> 'error'")
    return grouping.fullest_group(e, ["user_id"], "event_type", "props", F.lit(True)).select("user_id", "event_type", "n")


@query("""
SELECT user_id, array_to_string(list_distinct_in_order, ',') AS kinds FROM (
  SELECT user_id, list(event_type ORDER BY seen) AS list_distinct_in_order FROM (SELECT user_id, event_type, min((ts, event_id)) AS seen FROM events GROUP BY ALL) GROUP BY user_id)
""")
def ordered_distinct_union(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("seen"))
    own = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("seen", "event_type"))).alias("l"))
    return own.select("user_id", F.concat_ws(",", text.union_in_order(F.transform("l", lambda x: x["event_type"]))).alias("kinds"))


_PRICES = """
WITH l AS (SELECT l_orderkey, sum(l_extendedprice * (1 + l_tax) * (1 - l_discount)) AS total, count(*) AS lines FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey, o_orderdate, o_totalprice, c_custkey, c_acctbal, total, lines FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN l ON o_orderkey = l_orderkey),
s AS (SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'fail' WHEN c_acctbal < 0 THEN 'warn' ELSE 'ok' END AS customer,
  CASE WHEN o_orderdate > TIMESTAMP '1998-01-01' THEN 'review' ELSE 'ok' END AS dated,
  CASE WHEN total IS NULL THEN 'review' WHEN lines > 6 AND abs(total - o_totalprice) > 100000 THEN 'fail' ELSE 'ok' END AS price FROM o),
d AS (SELECT *, CASE WHEN customer = 'fail' OR price = 'fail' THEN 'reject' WHEN price = 'review' OR dated = 'review' OR customer = 'warn' THEN 'review' ELSE 'accept' END AS code,
  CASE WHEN customer = 'fail' OR price = 'fail' THEN concat_ws('; ', CASE WHEN customer = 'fail' THEN 'no customer' END, CASE WHEN price = 'fail' THEN 'wrong total' END)
  ELSE concat_ws('; ', CASE WHEN price = 'review' THEN 'no lines' END, CASE WHEN dated = 'review' OR price = 'review' THEN 'to be confirmed' END, CASE WHEN customer = 'warn' THEN 'remarks' END) END AS reasons,
  CASE WHEN 'fail' IN (customer, dated, price) THEN 'fail' WHEN 'review' IN (customer, dated, price) THEN 'review' WHEN 'warn' IN (customer, dated, price) THEN 'warn' ELSE 'ok' END AS worst FROM s)
"""
ORDER_RULES = {
    "reject": [
        {"when": {"check": "customer"}, "reason": "no customer"},
        {"when": {"check": "price", "status": ["fail"]}, "reason": "wrong total"},
    ],
    "review": [
        {"when": {"check": "price", "status": ["review"]}, "reason": "no lines"},
        {"when": {"any_status": ["review"]}, "reason": "to be confirmed"},
        {"when": {"any_status": ["warn", "fail"]}, "reason": "remarks"},
    ],
}


def order_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with checks, decision and worst status: joins for the facts, then one projection."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * (1 + F.col("l_tax")) * (1 - F.col("l_discount"))).alias("total"), F.count(F.lit(1)).alias("lines"))
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", F.lit(True).alias("known"))
    facts = table(spark, sf, "orders").join(customers, "o_custkey", "left").join(lines, "o_orderkey", "left")
    customer = F.when(F.col("known").isNull(), "fail").when(F.col("c_acctbal") < 0, "warn").otherwise("ok")
    dated = F.when(F.col("o_orderdate") > F.lit("1998-01-01").cast("timestamp"), "review").otherwise("ok")
    price = F.when(F.col("total").isNull(), "review").when((F.col("lines") > 6) & (F.abs(F.col("total") - F.col("o_totalprice")) > 100000), "fail").otherwise("ok")
    checks = rules.gather(rules.check("customer", customer), rules.check("dated", dated), rules.check("price", price))
    decided = facts.select("o_orderkey", checks.alias("checks"))
    decided = decided.withColumn("decision", rules.decide(ORDER_RULES, F.col("checks"), F.array().cast("array<string>")))
    return decided.withColumn("worst", grouping.worst(F.transform("checks", lambda c: c["status"])))


@query(_PRICES + "SELECT o_orderkey, code, reasons, worst FROM d")
def rule_engine_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return order_decisions(spark, sf).select("o_orderkey", F.col("decision.code").alias("code"), F.concat_ws("; ", "decision.reasons").alias("reasons"), "worst")


@query(_PRICES + "SELECT code, worst, count(*) AS n FROM d GROUP BY ALL")
def decision_counts(spark: SparkSession, sf: str) -> DataFrame:
    return order_decisions(spark, sf).groupBy(F.col("decision.code").alias("code"), "worst").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderkey, o_orderstatus AS status, strftime(o_orderdate, '%d.%m.%Y') AS dated, c_name AS customer, CASE WHEN c_mktsegment <> o_orderpriority THEN c_mktsegment || '->' || o_orderpriority END AS change
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
""")
def export_record_json(spark: SparkSession, sf: str) -> DataFrame:
    """Records as JSON, parsed again."""
    c = table(spark, sf, "customer")
    o = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    change = F.when(F.col("c_mktsegment") != F.col("o_orderpriority"), F.concat("c_mktsegment", F.lit("->"), "o_orderpriority"))
    record = F.struct(F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("dated"), F.struct(F.col("c_name").alias("name")).alias("customer"), change.alias("change"))
    back = F.from_json("json", "status string, dated string, customer struct<name:string>, change string")
    return o.select("o_orderkey", F.to_json(record).alias("json")).withColumn("r", back).select("o_orderkey", "r.status", "r.dated", F.col("r.customer.name").alias("customer"), "r.change")


# ---------------------------------------------------------------------------------------------------------------
# web pages


@query("""
SELECT page_id, trim(regexp_replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')) AS title,
  trim(regexp_replace(replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')) AS heading,
  len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS links, array_to_string(regexp_extract_all(html, '<a href="([^"]*)"', 1), ' ') AS hrefs FROM pages
""")
def html_title_and_links(spark: SparkSession, sf: str) -> DataFrame:
    """Title, heading and links of every page, from its tags."""
    parts = html.page_parts(table(spark, sf, "pages"), "page_id", "html")
    first = lambda part: F.min_by("value", F.when(F.col("part") == part, F.col("pos")))
    links = F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == "link", F.struct("pos", "name")))), lambda x: x["name"])
    return parts.groupBy("page_id").agg(first("title").alias("title"), first("h1").alias("heading"), F.count_if(F.col("part") == "link").alias("links"), F.array_join(links, " ").alias("hrefs"))


@query("""
WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '\\?(.*?)(?:#|$)', 1) AS args FROM pages),
v AS (SELECT page_id, 'Host' AS name, host AS value FROM p UNION ALL SELECT page_id, 'Address', url FROM p UNION ALL SELECT page_id, 'Arguments', args FROM p WHERE args <> '')
SELECT page_id, name, value FROM v
""")
def html_label_values(spark: SparkSession, sf: str) -> DataFrame:
    """Labels and values of a table of each page's address, written behind the page's own text: the first value that is not empty."""
    pages = table(spark, sf, "pages")
    escaped = lambda c: F.replace(c, F.lit("&"), F.lit("&amp;"))
    host, args = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), F.regexp_extract("url", r"\?(.*?)(?:#|$)", 1)
    rows = [("Host: ", host), ("Address", F.col("url")), ("Arguments:", F.lit("")), ("Arguments:", args), ("Host", F.lit("another"))]
    made = F.concat(*(F.concat(F.lit(f"<tr><th>{label}</th><td> "), escaped(v), F.lit("</td></tr>")) for label, v in rows))
    whole = pages.select("page_id", F.concat("html", F.lit("<table><tr><td>one cell</td></tr>"), made, F.lit("</table>")).alias("html"))
    return html.label_values(html.page_parts(whole, "page_id", "html"), "page_id", ("Host", "Address", "Arguments"))
