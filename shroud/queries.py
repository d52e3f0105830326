"""The engine's operators as queries over the driver's tables, each over whole tables, with SQL where SQL can say it."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import content, detect, text
from .functions.generalize import generalize
from .operators import profile as profiling
from .operators.dictionary import State, allocate, cut, lookup_rows
from .operators.scrub import resolve, restore, scrub, span_texts, splice, tokens_in
from .sources.sinks import json_records, write_parts
from .sources.tables import CELLS, parse_files, from_dataframe, read_cells
from .streaming.scrub import scrub_batch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_state(spark: SparkSession) -> State:
    """A state of its own for a query, in the shared folder if the cluster names one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="shroud-state-")
    return State(spark, f"{base if ':' in base else 'file://' + base}/state-{spark._jvm.java.util.UUID.randomUUID().toString()}")


# ---- detectors ----

_EMAIL = r"(^|[^\w.+-])([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"


@query(rf"""
WITH m AS (SELECT lang, unnest(regexp_extract_all(text, '{_EMAIL}', 2)) AS v FROM documents)
SELECT lang, count(*)::BIGINT AS emails, count(DISTINCT lower(v))::BIGINT AS distinct_emails FROM m GROUP BY lang
""")
def pii_email_by_lang(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.col("text").contains("@"))
    hits = docs.select("lang", F.explode(detect.extract(F.col("text"), *detect.places("EMAIL"))).alias("v"))
    return hits.groupBy("lang").agg(F.count("*").alias("emails"), F.countDistinct(detect.norm_column("EMAIL", F.col("v"))).alias("distinct_emails"))


# In this dialect nothing can look around: the left neighbour is part of the match, and so is all that would bar the right end.
_CARD = r"(^|[^\w-])(\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}[\w-]*)"
_CARD_CORE = r"\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}"
_LUHN = """list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse(d), i::INT, 1)::INT
  ELSE (2 * substr(reverse(d), i::INT, 1)::INT) // 10 + (2 * substr(reverse(d), i::INT, 1)::INT) % 10 END)) % 10 = 0"""


def _cards(source: str, of: str) -> str:
    return rf"""
WITH m AS (SELECT unnest(regexp_extract_all({source}, '{_CARD}', 2)) AS v FROM {of}),
c AS (SELECT regexp_replace(v, '\D', '', 'g') AS d FROM m WHERE regexp_full_match(v, '{_CARD_CORE}')),
k AS (SELECT d FROM c WHERE len(d) BETWEEN 13 AND 19 AND replace(d, d[1], '') <> '' AND {_LUHN})
SELECT d AS card, count(*)::BIGINT AS n FROM k GROUP BY d"""


def _count_cards(texts: DataFrame) -> DataFrame:
    found = texts.where(F.col("t").rlike(r"\d{4}")).select(F.explode(detect.extract(F.col("t"), *detect.places("CARD"))).alias("v"))
    return found.groupBy(detect.norm_column("CARD", F.col("v")).alias("card")).agg(F.count("*").alias("n"))


@query(_cards("text", "documents"))
def pii_card_luhn(spark, sf_dir):
    return _count_cards(table(spark, sf_dir, "documents").select(F.col("text").alias("t")))


@query(_cards("html", "pages"))
def html_card_luhn(spark, sf_dir):
    return _count_cards(table(spark, sf_dir, "pages").select(F.col("html").alias("t")))


_US_CORE = r"(?:\+1[-.\s]?)?(?:\([2-9]\d{2}\)\s?|[2-9]\d{2}[-.\s])\d{3}[-.\s]\d{4}"


def _phones(source: str, of: str, key: str) -> str:
    return rf"""
WITH m AS (SELECT {key}, unnest(regexp_extract_all({source}, '(^|[^\w+-])({_US_CORE}[\w-]*)', 2)) AS v FROM {of}),
c AS (SELECT {key}, v, regexp_replace(v, '\D', '', 'g') AS d FROM m WHERE regexp_full_match(v, '{_US_CORE}'))
SELECT {key}, CASE WHEN starts_with(v, '+1') AND len(d) = 11 THEN substr(d, 2) ELSE d END AS phone, count(*)::BIGINT AS n FROM c GROUP BY ALL"""


def _us_phones(rows: DataFrame, key: str, column: str) -> DataFrame:
    hits = rows.where(F.col(column).rlike(r"\d{3}[-.\s]\d{4}")).select(key, F.explode(detect.extract(F.col(column), 10)).alias("v"))
    return hits.groupBy(key, detect.norm_column("PHONE", F.col("v")).alias("phone")).agg(F.count("*").alias("n"))


@query(_phones("text", "documents", "doc_id"))
def pii_us_phone_norms(spark, sf_dir):
    return _us_phones(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(_phones("html", "pages", "page_id"))
def html_us_phones(spark, sf_dir):
    return _us_phones(table(spark, sf_dir, "pages"), "page_id", "html")


def _native(spark, sf_dir, source, key, expression, kind):
    rows = table(spark, sf_dir, source).select(F.col(key).alias("k"), F.expr(expression).alias("t"))
    hits = rows.select("k", F.explode(detect.extract(F.col("t"), *detect.places(kind))).alias("v"))
    return hits.select("k", F.col("v").alias("value"), detect.norm_column(kind, F.col("v")).alias("norm"))


_SSN_TEXT = "concat('no ', lpad(cast(o_orderkey % 1000 as string), 3, '0'), '-', lpad(cast(o_orderkey % 100 as string), 2, '0'), '-', lpad(cast(o_orderkey % 10000 as string), 4, '0'), ' end')"


@query("""
WITH s AS (SELECT o_orderkey AS k, printf('%03d', (o_orderkey % 1000)::INT) AS a, printf('%02d', (o_orderkey % 100)::INT) AS g, printf('%04d', (o_orderkey % 10000)::INT) AS n FROM orders)
SELECT k, a || '-' || g || '-' || n AS value, a || g || n AS norm FROM s WHERE a NOT IN ('000', '666') AND a < '900' AND g <> '00' AND n <> '0000'
""")
def pii_ssn(spark, sf_dir):
    return _native(spark, sf_dir, "orders", "o_orderkey", _SSN_TEXT, "SSN")


@query("""
WITH s AS (SELECT c_custkey AS k, printf('%02d%02d%02d', (c_custkey % 100)::INT, (c_custkey % 14)::INT, (c_custkey % 33)::INT) AS b, printf('%d%06d', (c_custkey % 10)::INT, (c_custkey % 1000000)::INT) AS r FROM customer)
SELECT k, CASE WHEN k % 2 = 0 THEN b || '-' || r ELSE b || r END AS value, b || r AS norm FROM s
WHERE substr(b, 3, 2)::INT BETWEEN 1 AND 12 AND substr(b, 5, 2)::INT BETWEEN 1 AND 31 AND r[1] BETWEEN '1' AND '8'
""")
def pii_rrn_synth(spark, sf_dir):
    born = "lpad(cast(c_custkey % 100 as string), 2, '0'), lpad(cast(c_custkey % 14 as string), 2, '0'), lpad(cast(c_custkey % 33 as string), 2, '0')"
    rest = "cast(c_custkey % 10 as string), lpad(cast(c_custkey % 1000000 as string), 6, '0')"
    return _native(spark, sf_dir, "customer", "c_custkey", f"concat('id ', {born}, if(c_custkey % 2 = 0, '-', ''), {rest}, '.')", "RRN")


@query("""
WITH s AS (SELECT c_custkey AS k, printf('%02d-%02d-%06d-%02d', (c_custkey % 40)::INT, (c_custkey % 100)::INT, c_custkey::INT, (c_custkey % 97)::INT) AS v FROM customer)
SELECT k, v AS value, replace(v, '-', '') AS norm FROM s WHERE substr(v, 1, 2)::INT BETWEEN 11 AND 28
""")
def pii_driver_synth(spark, sf_dir):
    return _native(spark, sf_dir, "customer", "c_custkey", "concat('면허 ', format_string('%02d-%02d-%06d-%02d', c_custkey % 40, c_custkey % 100, c_custkey, c_custkey % 97), ' ')", "DRIVER")


@query("""
WITH s AS (SELECT c_custkey AS k, printf('%04d', (c_custkey % 10000)::INT) AS a, printf('%04d', (c_custkey * 7 % 10000)::INT) AS b FROM customer)
SELECT k, CASE k % 3 WHEN 0 THEN '010-' || a || '-' || b WHEN 1 THEN '+82 10 ' || a || ' ' || b ELSE '02) ' || a || '-' || b END AS value,
  CASE k % 3 WHEN 2 THEN '02' ELSE '010' END || a || b AS norm FROM s
""")
def pii_kr_phone_synth(spark, sf_dir):
    a, b = "lpad(cast(c_custkey % 10000 as string), 4, '0')", "lpad(cast(c_custkey * 7 % 10000 as string), 4, '0')"
    made = f"case c_custkey % 3 when 0 then concat('tel ', '010-', {a}, '-', {b}) when 1 then concat('tel ', '+82 10 ', {a}, ' ', {b}) else concat('tel ', '02) ', {a}, '-', {b}) end"
    return _native(spark, sf_dir, "customer", "c_custkey", made, "PHONE")


@query("""
WITH s AS (SELECT s_suppkey AS k, chr(65 + (s_suppkey % 26)::INT) || printf('%08d', s_suppkey::INT) AS p, printf('%03d-%04d-%06d', (s_suppkey % 1000)::INT, (s_suppkey % 10000)::INT, s_suppkey::INT) AS a FROM supplier)
SELECT k, 'PASSPORT' AS kind, p AS value FROM s WHERE k % 2 = 0 UNION ALL SELECT k, 'ACCOUNT', a FROM s WHERE k % 3 = 0
""")
def pii_context_synth(spark, sf_dir):
    passport = "concat(if(s_suppkey % 2 = 0, 'Passport: ', 'code: '), char(65 + s_suppkey % 26), lpad(cast(s_suppkey as string), 8, '0'))"
    account = "concat(if(s_suppkey % 3 = 0, '계좌 ', '번호 '), format_string('%03d-%04d-%06d', s_suppkey % 1000, s_suppkey % 10000, s_suppkey))"
    parts = [_native(spark, sf_dir, "supplier", "s_suppkey", e, k).select("k", F.lit(k).alias("kind"), "value") for k, e in (("PASSPORT", passport), ("ACCOUNT", account))]
    return parts[0].unionByName(parts[1])


@query(rf"""
WITH e AS (SELECT lang, unnest(regexp_extract_all(text, '{_EMAIL}', 2)) AS v FROM documents),
p AS (SELECT lang, unnest(regexp_extract_all(text, '(^|[^\w+-])({_US_CORE}[\w-]*)', 2)) AS v FROM documents),
c0 AS (SELECT lang, unnest(regexp_extract_all(text, '{_CARD}', 2)) AS v FROM documents),
c AS (SELECT lang, regexp_replace(v, '\D', '', 'g') AS d FROM c0 WHERE regexp_full_match(v, '{_CARD_CORE}')),
k AS (SELECT lang FROM c WHERE len(d) BETWEEN 13 AND 19 AND replace(d, d[1], '') <> '' AND {_LUHN}),
u AS (SELECT lang, 'EMAIL' AS kind FROM e UNION ALL SELECT lang, 'PHONE' FROM p WHERE regexp_full_match(v, '{_US_CORE}') UNION ALL SELECT lang, 'CARD' FROM k)
SELECT lang, kind, count(*)::BIGINT AS n FROM u GROUP BY ALL
""")
def pii_kind_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(detect.GATE))

    def named(kind: str, place: int):
        return F.transform(detect.extract(F.col("text"), place), lambda v: F.lit(kind))

    arrays = [named("EMAIL", 2), named("CARD", 6), named("PHONE", 10)]
    return docs.select("lang", F.explode(F.flatten(F.array(*arrays))).alias("kind")).groupBy("lang", "kind").agg(F.count("*").alias("n"))


@query()
def pii_exact_matches(spark, sf_dir):
    """All detectors with their rules of precedence."""
    return detect.find_pii(table(spark, sf_dir, "documents"), "text", "doc_id")


def _found(source: str, of: str, key: str, then: str) -> str:
    return rf"""WITH
e AS (SELECT {key}, 'EMAIL' AS kind, unnest(regexp_extract_all({source}, '{_EMAIL}', 2)) AS value FROM {of}),
p0 AS (SELECT {key}, unnest(regexp_extract_all({source}, '(^|[^\w+-])({_US_CORE}[\w-]*)', 2)) AS value FROM {of}),
c0 AS (SELECT {key}, unnest(regexp_extract_all({source}, '{_CARD}', 2)) AS value FROM {of}),
c1 AS (SELECT {key}, value, regexp_replace(value, '\D', '', 'g') AS d FROM c0 WHERE regexp_full_match(value, '{_CARD_CORE}')),
found AS (SELECT {key}, kind, value, lower(value) AS norm FROM e
  UNION ALL SELECT {key}, 'CARD', value, d FROM c1 WHERE len(d) BETWEEN 13 AND 19 AND replace(d, d[1], '') <> '' AND {_LUHN}
  UNION ALL SELECT {key}, 'PHONE', value, CASE WHEN starts_with(value, '+1') AND len(regexp_replace(value, '\D', '', 'g')) = 11
    THEN substr(regexp_replace(value, '\D', '', 'g'), 2) ELSE regexp_replace(value, '\D', '', 'g') END FROM p0 WHERE regexp_full_match(value, '{_US_CORE}'))
{then}"""


@query(_found("text", "documents", "doc_id", "SELECT doc_id, kind, value, norm FROM found"))
def pii_exact_values(spark, sf_dir):
    """All detectors with their rules of precedence; the SQL has addresses, cards and US phone numbers only, and documents may hold more."""
    return detect.find_pii(table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id", "kind", "value", "norm")


@query(rf"""
WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '\s+')) AS v FROM documents),
d AS (SELECT v, regexp_replace(v, '\D', '', 'g') AS d FROM w),
k AS (SELECT CASE WHEN regexp_full_match(v, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}') THEN 'EMAIL'
  WHEN regexp_full_match(v, '\d{{6}}-?[1-8]\d{{6}}') AND substr(d, 3, 2)::INT BETWEEN 1 AND 12 AND substr(d, 5, 2)::INT BETWEEN 1 AND 31 THEN 'RRN'
  WHEN regexp_full_match(v, '(1[1-9]|2[0-8])-\d{{2}}-\d{{6}}-\d{{2}}') THEN 'DRIVER'
  WHEN regexp_full_match(v, '{_CARD_CORE}') AND len(d) BETWEEN 13 AND 19 AND replace(d, d[1], '') <> '' AND {_LUHN} THEN 'CARD'
  WHEN regexp_full_match(v, '\d{{3}}-\d{{2}}-\d{{4}}') AND substr(v, 1, 3) NOT IN ('000', '666') AND v < '9' AND substr(v, 5, 2) <> '00' AND substr(v, 8) <> '0000' THEN 'SSN'
  WHEN regexp_full_match(v, '(\+82[-.]?0?1[016789]|01[016789])[-.]?\d{{3,4}}[-.]?\d{{4}}|0(2|[3-6][1-5]|70)[-.)]\d{{3,4}}[-.]\d{{4}}') OR regexp_full_match(v, '{_US_CORE}') THEN 'PHONE' END AS kind FROM d)
SELECT kind, count(*)::BIGINT AS n FROM k WHERE kind IS NOT NULL GROUP BY kind
""")
def pii_classify(spark, sf_dir):
    """The kind of values that are one match from end to end."""
    kinds = F.pandas_udf(detect.kinds_of, "string")
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"\s+")).alias("v")).where(F.col("v").rlike(detect.GATE)).distinct()
    return words.withColumn("kind", kinds(F.col("v"))).where("kind is not null").groupBy("kind").agg(F.count("*").alias("n"))


# ---- shapes and profiles ----

_SHAPE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(substr(v, 1, 24), '[0-9]', '#', 'g'), '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '\\s', ' ', 'g') || CASE WHEN len(v) > 24 THEN '…' ELSE '' END"


@query(f"""
WITH r AS (SELECT 'customer' AS src, c_custkey AS k, c_name AS v FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'part', p_partkey, p_name FROM part),
s AS (SELECT src, {_SHAPE} AS shape, count(*)::BIGINT AS n, min(k) AS first FROM r GROUP BY ALL),
t AS (SELECT src, shape, n, row_number() OVER (PARTITION BY src ORDER BY n DESC, first)::INT AS place FROM s)
SELECT * FROM t WHERE place <= 3
""")
def shape_top3(spark, sf_dir):
    """The most frequent shapes of a column, from its profile."""
    parts = []
    for t, k, v in (("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name")):
        rows = profiling.profile_frame(from_dataframe(t, table(spark, sf_dir, t), k, [v]))
        parts.append(rows.select(F.lit(t).alias("src"), F.explode("shapes").alias("s")).select("src", "s.shape", "s.n", F.col("s.r").alias("place")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_CUSTOMER = ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


def _profile_sql(names, of: str) -> str:
    one = """SELECT '{0}' AS name, count(*)::BIGINT AS non_null, count(DISTINCT v)::BIGINT AS distinct_values, round(count(DISTINCT v) / count(*), 6) AS unique_share,
  CASE WHEN bool_and(regexp_full_match(v, '-?\\d+')) THEN 'int' WHEN bool_and(regexp_full_match(v, '-?\\d+(\\.\\d+)?')) THEN 'float'
    WHEN bool_and(regexp_full_match(v, '\\d{{4}}-\\d{{2}}-\\d{{2}}.*')) THEN 'date' ELSE 'str' END AS type
FROM (SELECT trim({0}::VARCHAR) AS v FROM {1}) WHERE v <> ''"""
    return " UNION ALL ".join(one.format(n, of) for n in names)


@query(_profile_sql(_CUSTOMER, "customer"))
def profile_customer(spark, sf_dir):
    t = from_dataframe("customer", table(spark, sf_dir, "customer"), "c_custkey", list(_CUSTOMER))
    rows = profiling.profile_frame(t)
    return rows.select("name", F.col("total").alias("non_null"), "distinct_values", F.round(F.col("distinct_values") / F.col("total"), 6).alias("unique_share"), "type")


@query("""
SELECT 'c_custkey' AS name, 'identifier' AS kind UNION ALL SELECT 'c_name', 'name' UNION ALL SELECT 'c_nationkey', NULL
UNION ALL SELECT 'c_mktsegment', NULL UNION ALL SELECT 'o_orderkey', CASE WHEN (SELECT count(*) FROM orders) >= 10 THEN 'identifier' END
UNION ALL SELECT 'o_orderdate', CASE WHEN (SELECT bool_and(strftime(o_orderdate, '%Y-%m-%d') ~ '^\\d{4}-\\d{2}-\\d{2}$') FROM orders) THEN 'date' END
UNION ALL SELECT 'o_orderstatus', NULL UNION ALL SELECT 'o_orderpriority', NULL
""")
def profile_kinds(spark, sf_dir):
    customer = from_dataframe("customer", table(spark, sf_dir, "customer").withColumn("customer_name", F.col("c_name")).select(F.col("c_custkey").alias("k"), F.col("c_custkey").alias("cust_key"), "customer_name", "c_nationkey", "c_mktsegment"), "k")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").alias("order_key"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderstatus", "o_orderpriority")
    shown = F.when(F.col("name") == "cust_key", "c_custkey").when(F.col("name") == "customer_name", "c_name").when(F.col("name") == "order_key", "o_orderkey").otherwise(F.col("name"))
    parts = [profiling.profile_frame(t).select(shown.alias("name"), "kind") for t in (customer, from_dataframe("orders", orders, "k"))]
    return parts[0].unionByName(parts[1])


_LINES = ("l_orderkey", "l_quantity", "l_returnflag", "l_linestatus", "ship_day")


@query(_profile_sql(_LINES, "(SELECT *, strftime(l_shipdate, '%Y-%m-%d') AS ship_day FROM lineitem)"))
def value_type_all(spark, sf_dir):
    """Types and counts of columns of integers, decimals, letters and days, from their profile."""
    lines = table(spark, sf_dir, "lineitem").withColumn("ship_day", F.date_format("l_shipdate", "yyyy-MM-dd")).withColumn("o", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    rows = profiling.profile_frame(from_dataframe("lineitem", lines, "o", list(_LINES)))
    return rows.select("name", F.col("total").alias("non_null"), "distinct_values", F.round(F.col("distinct_values") / F.col("total"), 6).alias("unique_share"), "type")


# ---- generalisation ----


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*)::BIGINT AS n FROM orders GROUP BY ALL")
def gen_date_month(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy/M/d")
    return table(spark, sf_dir, "orders").groupBy(generalize("date", day).alias("month")).agg(F.count("*").alias("n"))


@query("SELECT strftime(o_orderdate, '%Y') AS year, count(*)::BIGINT AS n FROM orders GROUP BY ALL")
def gen_birth_year(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyyMMdd")
    return table(spark, sf_dir, "orders").groupBy(generalize("birthdate", day).alias("year")).agg(F.count("*").alias("n"))


@query("SELECT (p_size // 5 * 5) || '-' || (p_size // 5 * 5 + 4) AS band, count(*)::BIGINT AS n FROM part GROUP BY ALL")
def gen_age_band(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(generalize("age", F.concat("p_size", F.lit(".0"))).alias("band")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN len(c_custkey::VARCHAR) > 3 THEN substr(c_custkey::VARCHAR, 1, 3) || '**' ELSE '[REDACTED]' END AS zip, count(*)::BIGINT AS n FROM customer GROUP BY ALL")
def gen_zip3(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(generalize("zip", F.concat(F.lit(" "), F.col("c_custkey").cast("string"))).alias("zip")).agg(F.count("*").alias("n"))


@query(r"SELECT n_nationkey, trim(regexp_replace(n_name, '\s*\d[\d-]*\s*', ' ', 'g')) || ', ' || r_name AS address FROM nation JOIN region ON n_regionkey = r_regionkey")
def gen_address_en(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    address = F.concat(F.col("n_nationkey").cast("string"), F.lit(" Main Street, "), "n_name", F.lit(" 123-45, , "), "r_name")
    return rows.select("n_nationkey", generalize("address", address).alias("address"))


@query("""
SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '서울시 강남구' WHEN 1 THEN '경기도 수원시 영통구' ELSE '강원도' END AS address FROM supplier
""")
def gen_address_kr(spark, sf_dir):
    made = F.expr("concat(element_at(array('서울시 강남구 새길로 ', '경기도 수원시 영통구 ', '강원도 산길 '), cast(s_suppkey % 3 + 1 as int)), s_suppkey)")
    return table(spark, sf_dir, "supplier").select("s_suppkey", generalize("address", made).alias("address"))


@query("""
SELECT g.band, n_name, count(*)::BIGINT AS n FROM (SELECT (c_custkey % 90 // 5 * 5) || '-' || (c_custkey % 90 // 5 * 5 + 4) AS band, c_nationkey FROM customer) g
JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL HAVING count(*) < 5
""")
def quasi_kanonymity(spark, sf_dir):
    """Groups of quasi-identifiers that fewer than five rows share, after generalisation."""
    band = generalize("age", (F.col("c_custkey") % 90).cast("string"))
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.groupBy(band.alias("band"), "n_name").agg(F.count("*").alias("n")).where("n < 5")


# ---- pseudonyms ----


def _no_mapping(spark) -> DataFrame:
    return spark.createDataFrame([], "entity string, norm string, raw string, token string, n long")


def _keys(df: DataFrame, entity: str, value: str, order: str, rank: int = 0) -> DataFrame:
    seen = F.struct(F.lit(rank).alias("a"), F.col(order).cast("long").alias("b"))
    return df.select(F.lit(entity).alias("entity"), text.strip(F.col(value).cast("string")).alias("norm"), F.col(value).cast("string").alias("raw"), seen.alias("seen"))


@query("SELECT 'CUSTOMER' AS entity, c_name AS norm, printf('CUSTOMER_%06d', (row_number() OVER (ORDER BY min(c_custkey)))::INT) AS token FROM customer GROUP BY c_name")
def token_customer(spark, sf_dir):
    return allocate(_keys(table(spark, sf_dir, "customer"), "CUSTOMER", "c_name", "c_custkey"), _no_mapping(spark)).select("entity", "norm", "token")


@query("""
WITH t AS (SELECT c_custkey, printf('CUSTOMER_%06d', (row_number() OVER (ORDER BY c_custkey))::INT) AS token FROM customer)
SELECT token, count(*)::BIGINT AS orders, sum(o_totalprice)::DECIMAL(38, 2)::VARCHAR AS total FROM orders JOIN t ON o_custkey = c_custkey GROUP BY token
""")
def token_join_stable(spark, sf_dir):
    """Both tables pseudonymised, then joined on the pseudonyms."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    known = cut(allocate(_keys(customer, "CUSTOMER", "c_custkey", "c_custkey"), _no_mapping(spark)).select("norm", "token"))
    left = customer.join(known, F.col("c_custkey").cast("string") == F.col("norm")).select("token")
    right = orders.join(known, F.col("o_custkey").cast("string") == F.col("norm")).select("token", F.col("o_totalprice").cast("decimal(38,2)").alias("price"))
    return left.join(right, "token").groupBy("token").agg(F.count("*").alias("orders"), F.sum("price").cast("decimal(38,2)").cast("string").alias("total"))


@query("""
WITH r AS (SELECT c_mktsegment AS v, 0 AS a, c_custkey AS b FROM customer UNION ALL SELECT p_brand, 1, p_partkey FROM part UNION ALL SELECT c_mktsegment, 2, c_custkey FROM customer),
f AS (SELECT v, min(a * 1000000000 + b) AS first FROM r GROUP BY v)
SELECT v AS norm, printf('LABEL_%06d', (row_number() OVER (ORDER BY first))::INT) AS token FROM f
""")
def token_shared_entity(spark, sf_dir):
    customer, part = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    keys = _keys(customer, "LABEL", "c_mktsegment", "c_custkey").unionByName(_keys(part, "LABEL", "p_brand", "p_partkey", 1)).unionByName(_keys(customer, "LABEL", "c_mktsegment", "c_custkey", 2))
    return allocate(keys, _no_mapping(spark)).select("norm", "token")


@query("""
WITH a AS (SELECT o_custkey AS v, row_number() OVER (ORDER BY min(o_orderkey)) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1),
b AS (SELECT o_custkey AS v, row_number() OVER (ORDER BY min(o_orderkey)) + (SELECT count(*) FROM a) AS n FROM orders
  WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_custkey NOT IN (SELECT v FROM a) GROUP BY 1)
SELECT v::VARCHAR AS norm, printf('C_%06d', n::INT) AS token FROM (SELECT * FROM a UNION ALL SELECT * FROM b)
""")
def token_incremental(spark, sf_dir):
    """Two batches: the second one numbers only what the first one has not."""
    orders, split = table(spark, sf_dir, "orders"), F.lit("1996-01-01").cast("timestamp")
    one = cut(allocate(_keys(orders.where(F.col("o_orderdate") < split), "C", "o_custkey", "o_orderkey"), _no_mapping(spark)))
    two = allocate(_keys(orders.where(F.col("o_orderdate") >= split), "C", "o_custkey", "o_orderkey"), one)
    return one.unionByName(two).select("norm", "token")


# ---- dictionaries ----


@query("""
WITH v AS (SELECT 'customer_id' AS col, c_custkey AS o, (c_custkey * 37)::VARCHAR AS surface FROM customer UNION ALL SELECT 'customer_name', c_custkey, c_name FROM customer),
m AS (SELECT * FROM v WHERE CASE WHEN regexp_full_match(trim(surface), '\\d+') THEN len(trim(surface)) >= 5 ELSE len(trim(surface)) >= 3 END)
SELECT col, surface, row_number() OVER (PARTITION BY col ORDER BY min(o))::BIGINT AS n FROM m GROUP BY col, surface
""")
def mask_register(spark, sf_dir):
    """Values of columns that are masked until someone decides, profiled and registered; values that are not distinctive stay out."""
    from .operators.apply import register_masks

    made = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o"), (F.col("c_custkey") * 37).alias("customer_id"), F.col("c_name").alias("customer_name"), "c_mktsegment")
    t, state = from_dataframe("customer", made, "o"), own_state(spark)
    register_masks(state, "f", [t], [profiling.TableProfile(t.name, 0, profiling.profile_columns(t))])
    return state.lookups().select(F.from_json("column", "array<string>")[1].alias("col"), "surface", F.regexp_extract("replacement", r"(\d+)$", 1).cast("long").alias("n"))


@query("""
SELECT event_type AS "column", user_id::VARCHAR AS surface, arg_max(event_id, event_id)::VARCHAR AS replacement FROM events GROUP BY ALL
""")
def mask_upsert_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.lit("f").alias("file_id"), F.col("event_type").alias("column"), F.col("user_id").cast("string").alias("surface"), F.col("event_id").cast("string").alias("replacement"), F.col("event_id").alias("place"))
    return lookup_rows(rows).select("column", "surface", "replacement")


@query("""
SELECT event_type AS "column", user_id::VARCHAR AS surface, max(event_id)::VARCHAR AS replacement FROM events
WHERE event_type <> (SELECT min(event_type) FROM events) GROUP BY ALL
""")
def mask_forget(spark, sf_dir):
    """A state with all masks, from which one column is dropped again."""
    events = table(spark, sf_dir, "events")
    rows = events.select(F.lit("f").alias("file_id"), F.col("event_type").alias("column"), F.col("user_id").cast("string").alias("surface"), F.col("event_id").cast("string").alias("replacement"), F.col("event_id").alias("place"))
    state = own_state(spark)
    state.add_lookups(rows)
    state.commit(forget=[("f", events.agg(F.min("event_type")).first()[0])])
    return state.lookups().select("column", "surface", "replacement")


# ---- scrubbing ----


@query(r"""
WITH s AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[0-9A-Za-z](?:[0-9A-Za-z@.+\-_]*[0-9A-Za-z])?')) AS span FROM conversations),
d AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[0-9A-Za-z](?:[0-9A-Za-z@.+\-_]*[0-9A-Za-z])?')) AS surface FROM benchmark)
SELECT span, 'W_' || len(span) AS replacement, 1::INT AS hits FROM s JOIN d ON span = surface
""")
def scrub_dictionary(spark, sf_dir):
    """Spans of conversations that a dictionary of the benchmark's words knows."""
    def words(name):
        return table(spark, sf_dir, name).select(F.explode(span_texts(F.col("text"))).alias("span")).where(F.col("span").rlike("^[0-9A-Za-z@.+_-]+$")).distinct()

    known = words("benchmark").select(F.col("span").alias("surface"), F.concat(F.lit("W_"), F.length("span")).alias("replacement"), F.lit(1).alias("seq"))
    spans = words("conversations").join(known, F.col("span") == F.col("surface"), "left_semi")
    return resolve(spans, known, spark.createDataFrame([], "token string"))


@query("""
WITH RECURSIVE b AS (SELECT text AS surface, row_number() OVER (ORDER BY len(text) DESC, text) AS i FROM (SELECT DISTINCT text FROM benchmark WHERE len(text) > 0)),
h AS (SELECT doc_id, text, i, surface FROM documents JOIN b ON contains(text, surface)),
r AS (SELECT doc_id, text, 0::BIGINT AS i, 0::BIGINT AS hits FROM documents WHERE doc_id IN (SELECT doc_id FROM h)
  UNION ALL SELECT r.doc_id, replace(r.text, n.surface, 'PASSAGE'), n.i, r.hits + (len(r.text) - len(replace(r.text, n.surface, ''))) // len(n.surface)
  FROM r JOIN h n ON n.doc_id = r.doc_id AND n.i = (SELECT min(i) FROM h x WHERE x.doc_id = r.doc_id AND x.i > r.i)),
l AS (SELECT doc_id, arg_max(text, i) AS text, arg_max(hits, i) AS hits FROM r GROUP BY doc_id)
SELECT doc_id, len(text)::BIGINT AS n_chars, md5(text) AS digest, hits::BIGINT AS hits FROM l
""")
def scrub_multiword(spark, sf_dir):
    """Documents with the benchmark's passages replaced, the longest first."""
    from .operators.scrub import multiword

    known = table(spark, sf_dir, "benchmark").select(F.col("text").alias("surface")).where("surface <> ''").distinct()
    known = known.select("surface", F.lit("PASSAGE").alias("replacement"), F.lit(True).alias("multiword"), F.lit(1).alias("seq"))
    out = multiword(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", known).where("hits > 0")
    return out.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"), F.col("hits").cast("long").alias("hits"))


@query()
def scrub_documents(spark, sf_dir):
    out = scrub(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["doc_id"], own_state(spark))
    return out.where("hits > 0").select("doc_id", "hits", "text", F.size(tokens_in(F.col("text"))).alias("n_tokens"))


@query("SELECT doc_id, true AS same FROM documents WHERE text IS NOT NULL")
def restore_roundtrip(spark, sf_dir):
    """Scrub and restore: the text is back, up to the first-seen spelling of each detected value."""
    docs, state = table(spark, sf_dir, "documents").select("doc_id", "text"), own_state(spark)
    back = restore(scrub(docs, "text", ["doc_id"], state), "text", ["doc_id"], state).select("doc_id", F.col("text").alias("back"))
    found = detect.find_pii(docs, "text", "doc_id").withColumnRenamed("kind", "entity").join(state.mapping().select("entity", "norm", "raw"), ["entity", "norm"])
    edits = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", F.col("end").alias("stop"), F.col("raw").alias("text"))).alias("edits"))
    first_seen = docs.join(edits, "doc_id", "left").select("doc_id", splice(F.col("text"), F.coalesce("edits", F.array().cast("array<struct<start:int,stop:int,text:string>>"))).alias("expected"))
    return first_seen.where("expected is not null").join(back, "doc_id").select("doc_id", (F.col("back") == F.col("expected")).alias("same"))


@query(_found("text", "conversations", "role", """, n AS (SELECT role, count(*)::BIGINT AS hits FROM found WHERE role = 'user' GROUP BY role)
SELECT role, false AS withheld, count(*)::BIGINT AS n, coalesce(max(hits), 0)::BIGINT AS hits FROM conversations LEFT JOIN n USING (role) GROUP BY role"""))
def stream_scrub_conversations(spark, sf_dir):
    """A batch as the stream gets it: what users say is scrubbed, responses pass."""
    rows = table(spark, sf_dir, "conversations").withColumn("door", F.when(F.col("role") == "user", "prompt").otherwise("response"))
    return scrub_batch(rows, "text", ["conv_id", "turn"], own_state(spark), door="door").groupBy("role", "withheld").agg(F.count("*").alias("n"), F.sum("hits").alias("hits"))


@query("""
SELECT c_custkey || '.0' AS span, 'R' || c_custkey AS replacement, 1::INT AS hits FROM customer UNION ALL SELECT c_custkey || '에게', 'R' || c_custkey || '에게', 1 FROM customer
UNION ALL SELECT 'ab_' || c_custkey || '_x', 'ab_R' || c_custkey || '_x', 1 FROM customer UNION ALL SELECT c_custkey || '_' || c_custkey, 'R' || c_custkey || '_R' || c_custkey, 2 FROM customer
""")
def scrub_fallbacks(spark, sf_dir):
    """Spans that are known as an integer, without a particle, or by their parts; and some that are not known."""
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"))
    spans = k.select(F.explode(F.expr("array(k || '.0', k || '에게', 'ab_' || k || '_x', k || '_' || k, k || '.5', 'x' || k, k || '안녕')")).alias("span")).distinct()
    known = k.select(F.col("k").alias("surface"), F.concat(F.lit("R"), "k").alias("replacement"), F.lit(1).alias("seq"))
    return resolve(spans, known, spark.createDataFrame([], "token string"))


@query(_found("text", "documents", "doc_id", "SELECT doc_id, count(*)::BIGINT AS hits, count(DISTINCT (kind, norm))::BIGINT AS n_tokens FROM found GROUP BY doc_id"))
def scrub_document_hits(spark, sf_dir):
    """Every document scrubbed: how many values were replaced, by how many different pseudonyms."""
    out = scrub(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["doc_id"], own_state(spark))
    return out.where("hits > 0").select("doc_id", F.col("hits").cast("long").alias("hits"), F.size(tokens_in(F.col("text"))).cast("long").alias("n_tokens"))


# ---- JSON and paths ----


@query("""
SELECT k AS key, count(*)::BIGINT AS n, count(DISTINCT json_extract_string(props, k))::BIGINT AS distinct_values
FROM (SELECT props, unnest(json_keys(props)) AS k FROM events WHERE props IS NOT NULL) GROUP BY k
""")
def json_leaves(spark, sf_dir):
    """Values of nested JSON with their keys, as masks for them are looked for."""
    from .engine import leaves

    @F.pandas_udf("array<struct<key:string,value:string>>")
    def found(texts):
        import json

        return texts.map(lambda t: [{"key": k, "value": v} for k, v, _ in leaves(json.loads(t))], na_action="ignore")

    rows = table(spark, sf_dir, "events").select(F.explode(found("props")).alias("l")).select("l.*")
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("value").alias("distinct_values"))


@query("""
SELECT event_id, k AS key, CASE json_type(props, k) WHEN 'BOOLEAN' THEN json_extract_string(props, k) ELSE nullif(regexp_replace(json_extract_string(props, k), '^(-?\\d+)\\.0+$', '\\1'), '') END AS cell
FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events WHERE props IS NOT NULL)
""")
def json_cell_text(spark, sf_dir):
    """JSON values as cells, by the rule of all readers."""
    from .sources.parse import cell

    @F.pandas_udf("array<struct<key:string,cell:string>>")
    def cells(texts):
        import json

        return texts.map(lambda t: [{"key": k, "cell": cell(v)} for k, v in json.loads(t).items()], na_action="ignore")

    return table(spark, sf_dir, "events").select("event_id", F.explode(cells("props")).alias("c")).select("event_id", "c.*")


@query("""
SELECT page_id, list_distinct(regexp_extract_all(url || '.csv', '[^\\s''"()=;&|<>,]+\\.(?:csv|tsv|xlsx|jsonl?)'))[1] AS path FROM pages WHERE url IS NOT NULL AND NOT regexp_matches(url, '[\\s''"()=;&|<>,#?]')
""")
def command_paths(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").where(F.col("url").isNotNull() & ~F.col("url").rlike(r"""[\s'"()=;&|<>,#?]"""))
    return rows.select("page_id", content.data_paths_column(F.concat(F.lit("cat "), "url", F.lit(".csv > x")))[0].alias("path"))


# ---- files: tables written by the sinks and read back by the sources ----


def _scratch(spark) -> str:
    return own_state(spark).root


def _cells(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.where("ord >= 0").select(*[F.col("cells")[i].alias(n) for i, n in enumerate(names)])


@query("SELECT c_custkey::VARCHAR AS k, c_name || ', \"' || c_mktsegment || '\"' AS label, nullif(repeat('x', (c_nationkey % 3)::INT), '') AS blank FROM customer")
def source_delimited(spark, sf_dir):
    """Quotes, separators and empty cells through part files and back."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.expr("concat(c_name, ', \"', c_mktsegment, '\"')").alias("label"), F.expr("repeat('x', c_nationkey % 3)").alias("blank"))
    folder = _scratch(spark)
    write_parts(from_dataframe("customer", rows.withColumn("o", F.col("k")), "o", ["k", "label", "blank"]), folder)
    return _cells(read_cells(spark, f"{folder}/*.csv"), ["k", "label", "blank"])


@query("SELECT s_suppkey::VARCHAR AS k, s_name AS name, s_nationkey::VARCHAR AS nation FROM supplier")
def source_json_lines(spark, sf_dir):
    folder = _scratch(spark)
    write_parts(from_dataframe("supplier", table(spark, sf_dir, "supplier").coalesce(1).withColumn("o", F.col("s_suppkey")), "o", ["s_suppkey", "s_name", "s_nationkey"]), folder, "jsonl")
    files = spark.read.format("binaryFile").load(f"{folder}/*.json").select(F.regexp_replace("path", r"\.json$", ".jsonl").alias("path"), "content")
    return _cells(files.mapInArrow(parse_files, CELLS), ["k", "name", "nation"])


@query("SELECT n_nationkey::VARCHAR AS k, n_name AS name, CASE WHEN n_regionkey = 0 THEN NULL ELSE n_regionkey::VARCHAR END AS region, '[' || n_nationkey || ', \"' || n_name || '\"]' AS nested FROM nation")
def source_json(spark, sf_dir):
    """A list of records with nulls and nested values."""
    record = F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.expr("nullif(n_regionkey, 0)").alias("region"))
    rows = table(spark, sf_dir, "nation").select(F.to_json(record, {"ignoreNullFields": "false"}).alias("j"), F.expr("concat('[', n_nationkey, ',\"', n_name, '\"]')").alias("n"))
    whole = rows.agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.expr("concat(substring(j, 1, length(j) - 1), ',\"nested\":', n, '}')")), ",\n"), F.lit("]")).alias("t"))
    files = whole.select(F.lit("nation.json").alias("path"), F.col("t").cast("binary").alias("content"))
    return _cells(files.mapInArrow(parse_files, CELLS), ["k", "name", "region", "nested"])


@query("""
SELECT n_nationkey AS k, '[' || array_to_string(CASE n_nationkey % 6
  WHEN 0 THEN ['a|b', n_nationkey || '|' || n_name, '7|~'] WHEN 1 THEN ['col_1|col_2', n_nationkey || '|' || n_name, '2.5|~'] WHEN 2 THEN ['_key|a|b', 'x|' || n_nationkey || '|~', 'y|~|' || n_name]
  WHEN 3 THEN ['a|b', 'true|' || n_name, '~|[1, "z"]'] WHEN 4 THEN ['a|b|col_3', n_nationkey || '|' || n_name || '|3', '1|~|~'] ELSE ['이름|b', '가|' || n_name] END, ', ') || ']' AS lines FROM nation
""")
def source_shapes(spark, sf_dir):
    """A small file for each nation: split, lists, records by key, JSON lines, ragged CSV, and CSV in an encoding that is not UTF-8."""
    made = F.expr("""CASE k % 6 WHEN 0 THEN concat('{"columns":["a","b"],"data":[[', k, ',"', n, '"],[7.0,null]]}') WHEN 1 THEN concat('[[', k, ',"', n, '"],[2.5]]')
      WHEN 2 THEN concat('{"x":{"a":', k, '},"y":{"b":"', n, '"}}') WHEN 3 THEN concat('{"a":true,"b":"', n, '"}\\n\\n{"a":null,"b":[1,"z"]}')
      WHEN 4 THEN concat('a,b\\n', k, ',"', n, '",3\\n1') ELSE concat('이름,b\\n가,', n) END""")
    kind = F.expr("CASE WHEN k % 6 < 3 THEN '.json' WHEN k % 6 = 3 THEN '.jsonl' ELSE '.csv' END")

    @F.pandas_udf("binary")
    def coded(texts, k):
        return texts.combine(k, lambda t, i: t.encode("cp949" if i % 6 == 5 else "utf-8"))

    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("k"), F.col("n_name").alias("n"))
    files = rows.select(F.concat(F.col("k").cast("string"), kind).alias("path"), coded(made, F.col("k")).alias("content"))
    cells = files.mapInArrow(parse_files, CELLS).select(F.split("path", r"\.")[0].cast("int").alias("k"), "ord", F.concat_ws("|", F.transform("cells", lambda c: F.coalesce(c, F.lit("~")))).alias("line"))
    lines = cells.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("l"))
    return lines.select("k", F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["line"]), ", "), F.lit("]")).alias("lines"))


@query("SELECT r_regionkey::VARCHAR AS k, r_name AS name, strftime(DATE '1899-12-30' + (32874 + r_regionkey)::INT, '%Y-%m-%d') AS day FROM region")
def source_workbook(spark, sf_dir):
    """A workbook with numbers, inline text and dates, made by the executors."""
    rows = table(spark, sf_dir, "region").select("r_regionkey", "r_name").agg(F.sort_array(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("rows"))

    def make(batches):
        import io
        import zipfile

        import pyarrow as pa

        main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        for batch in batches:
            for found in batch["rows"].to_pylist():
                text = '<c r="{}" t="inlineStr"><is><t>{}</t></is></c>'.format
                lines = "<row>" + text("A1", "k") + text("B1", "name") + text("C1", "day") + "</row>"
                for i, r in enumerate(found, 2):
                    lines += f'<row><c r="A{i}"><v>{r["r_regionkey"]}</v></c>{text(f"B{i}", r["r_name"])}<c r="C{i}" s="1"><v>{32874 + r["r_regionkey"]}</v></c></row>'
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="region" r:id="r1"/></sheets></workbook>')
                    z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/a.xml"/></Relationships>')
                    z.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
                    z.writestr("xl/worksheets/a.xml", f"<worksheet {main}><sheetData>{lines}</sheetData></worksheet>")
                yield pa.record_batch([pa.array(["region.xlsx"]), pa.array([out.getvalue()], pa.binary())], names=["path", "content"])

    return _cells(rows.mapInArrow(make, "path string, content binary").mapInArrow(parse_files, CELLS), ["k", "name", "day"])


@query("SELECT n_nationkey AS k, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"note\":null}' AS value FROM nation")
def sink_json_records(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.lit(None).cast("string").alias("note"))
    out = json_records(rows)
    return out.select(F.get_json_object("value", "$.n_nationkey").cast("int").alias("k"), "value")


# ---- scalars of the engine, on values made from keys ----


@query("""
WITH v AS (SELECT c_custkey AS k, ['김','이','박','쀍','abc'][(c_custkey % 5 + 1)::INT] || ['하늘','서','명','나 무','새벽길'][(c_custkey // 5 % 5 + 1)::INT] AS v FROM customer)
SELECT k, v, k % 5 < 3 AND k // 5 % 5 IN (0, 1, 4) AS person FROM v
""")
def name_like_synth(spark, sf_dir):
    made = "concat(element_at(array('김','이','박','쀍','abc'), cast(c_custkey % 5 + 1 as int)), element_at(array('하늘','서','명','나 무','새벽길'), cast(c_custkey div 5 % 5 + 1 as int)))"
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.expr(made).alias("v"))
    return rows.withColumn("person", text.name_like(F.col("v")))


@query("""
WITH v AS (SELECT o_orderkey AS k, o_orderkey % 15 AS m, o_orderkey % 34 AS d FROM orders)
SELECT k, CASE k % 3 WHEN 0 THEN printf('2024-%d-%d', m::INT, d::INT) WHEN 1 THEN printf('2024%02d%02d', m::INT, d::INT) ELSE printf('2024/%d/%d 10:00', m::INT, d::INT) END AS v,
  m BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31 AS is_date FROM v
""")
def is_date_synth(spark, sf_dir):
    m, d = "o_orderkey % 15", "o_orderkey % 34"
    made = f"case o_orderkey % 3 when 0 then format_string('2024-%d-%d', {m}, {d}) when 1 then format_string('2024%02d%02d', {m}, {d}) else format_string('2024/%d/%d 10:00', {m}, {d}) end"
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.expr(made).alias("v"))
    return rows.withColumn("is_date", text.is_date(F.col("v")))


@query("SELECT page_id, '/' || split_part(split_part(url, '://', 2), '/', 1) || '/c' AS path FROM pages WHERE url LIKE '%://%/%' AND NOT contains(split_part(split_part(url, '://', 2), '/', 1), '?')")
def path_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").where("url like '%://%/%'").select("page_id", F.split(F.split("url", "://")[1], "/")[0].alias("h")).where("not contains(h, '?')")
    return rows.select("page_id", content.normalize_path_column(F.concat(F.lit("/./a//..\\\\"), "h", F.lit("/b/../../"), "h", F.lit("/./c/"))).alias("path"))


@query(r"""
WITH f AS (SELECT conv_id, turn, trim(regexp_replace(text, '[\x00-\x1f\x7f]+', ' ', 'g')) AS t FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, to_json(CASE WHEN len(t) > 40 THEN substr(t, 1, 40) || '…' ELSE t END)::VARCHAR AS shown FROM f
""")
def dialog_text(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    return rows.select("conv_id", "turn", content.for_dialog_column(F.col("text"), 40).alias("shown"))


@query("""
SELECT c_custkey, [printf('CUSTOMER_%06d', c_custkey::INT), printf('A_B_%07d', c_custkey::INT)]::VARCHAR AS tokens FROM customer
""")
def tokens_in_text(spark, sf_dir):
    made = "format_string('see CUSTOMER_%06d이, xCUSTOMER_%06d, CUSTOMER_12345 A_B_%07d and CUSTOMER_%06d', c_custkey, c_custkey, c_custkey, c_custkey)"
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("["), F.array_join(tokens_in(F.expr(made)), ", "), F.lit("]")).alias("tokens"))


@query("SELECT c_custkey, 'call ' || c_name || '이 or CUSTOMER_999999' AS text FROM customer")
def restore_known(spark, sf_dir):
    """Texts with pseudonyms that the state knows, and one that it does not."""
    customer, state = table(spark, sf_dir, "customer"), own_state(spark)
    known = cut(allocate(_keys(customer, "CUSTOMER", "c_name", "c_custkey"), state.mapping()))
    state.commit(mapping=known)
    texts = customer.join(known, F.col("c_name") == F.col("raw")).select("c_custkey", F.concat(F.lit("call "), "token", F.lit("이 or CUSTOMER_999999")).alias("text"))
    return restore(texts, "text", ["c_custkey"], state)


@query("SELECT conv_id, count(*)::BIGINT AS texts, sum(len(text))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def content_blocks(spark, sf_dir):
    """Conversations as content blocks: texts taken out, changed, and put back into their places."""
    made = "case turn % 3 when 0 then named_struct('type', 'text', 'text', text, 'result', null, 'blocks', null) when 1 then named_struct('type', 'tool_result', 'text', null, 'result', text, 'blocks', null) else named_struct('type', 'tool_result', 'text', null, 'result', null, 'blocks', array(named_struct('type', 'image', 'text', cast(null as string)), named_struct('type', 'text', 'text', text))) end"
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.expr(made)).alias("b")).select("conv_id", F.col("b").cast(content.BLOCKS).alias("b"))
    back = rows.select("conv_id", content.with_texts_column(F.col("b"), F.transform(content.texts_of_column(F.col("b")), F.reverse)).alias("b"))
    texts = back.select("conv_id", content.texts_of_column(F.col("b")).alias("t"))
    return texts.select("conv_id", F.size("t").cast("long").alias("texts"), F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("chars"))


# ---- decisions, applied ----


@query("""
SELECT printf('%06d', c_custkey::INT) AS k, printf('PERSON_%06d', (row_number() OVER (ORDER BY c_custkey))::INT) AS customer_name,
  CASE WHEN len(c_custkey::VARCHAR) > 3 THEN substr(c_custkey::VARCHAR, 1, 3) || '**' ELSE '[REDACTED]' END AS zip,
  (c_custkey % 90 // 5 * 5) || '-' || (c_custkey % 90 // 5 * 5 + 4) AS age,
  'agent ' || printf('PERSON_%06d', (row_number() OVER (ORDER BY c_custkey))::INT) || ' on ' || printf('PHONE_%06d', (row_number() OVER (ORDER BY c_custkey))::INT) AS memo
FROM customer
""")
def apply_customer(spark, sf_dir):
    """A table profiled, decided and copied: pseudonyms, coarser values, a dropped column, and free text scrubbed against the masks."""
    from .operators.apply import apply_plan
    from .operators.profile import TableProfile
    from .plans.decisions import compile_plan

    made = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o"), F.format_string("%06d", "c_custkey").alias("k"), F.col("c_name").alias("customer_name"), F.col("c_custkey").cast("string").alias("zip"),
        (F.col("c_custkey") % 90).cast("string").alias("age"), F.col("c_mktsegment").alias("segment"),
        F.concat(F.lit("agent "), "c_name", F.lit(" on 010-"), F.format_string("%04d-%04d", F.expr("c_custkey div 10000"), F.expr("c_custkey % 10000"))).alias("memo"),
    )
    t = from_dataframe("customer", made, "o")
    found = [TableProfile(t.name, 0, profiling.profile_columns(t))]
    decisions = [
        {"column": "customer_name", "action": "pseudonymize", "entity": "person"}, {"column": "segment", "action": "drop"}, {"column": "age", "action": "generalize"},
        {"column": "memo", "action": "keep"}, {"column": "#1", "action": "keep"},
    ]
    (copy,) = apply_plan(own_state(spark), "f", [t], compile_plan(decisions, found))
    return copy.df.select(*[F.col(p).alias(n) for p, n in zip(copy.physical, copy.columns)])


@query("""
WITH v AS (SELECT 'text' AS name, trim(text) AS v FROM documents UNION ALL SELECT 'lang', trim(lang) FROM documents UNION ALL SELECT 'source', trim(source) FROM documents),
s AS (SELECT name, count(*)::BIGINT AS total, count(DISTINCT v)::BIGINT AS distinct_values, sum(len(v)) / count(*) >= 30 AS long FROM v WHERE v <> '' GROUP BY name)
SELECT name, 'str' AS type, total, distinct_values, CASE WHEN long THEN 'free_text' END AS kind FROM s
""")
def profile_documents(spark, sf_dir):
    """The profile of a table with long texts."""
    t = from_dataframe("documents", table(spark, sf_dir, "documents"), "doc_id", ["text", "lang", "source"])
    return profiling.profile_frame(t).select("name", "type", "total", "distinct_values", "kind")


@query()
def status_files(spark, sf_dir):
    """The status of a project with one file only guarded and one decided, of the first customers."""
    from .engine import Engine

    base = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://").removeprefix("file:")
    root = Path(tempfile.mkdtemp(prefix="shroud-project-", dir=base if base.startswith("/") and Path(base).is_dir() else None))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", (F.col("c_custkey") % 90).alias("age")).orderBy("c_custkey").limit(20).collect()
    made = "customer_id,customer_name,age\n" + "".join(f"{r[0]},{r[1]},{r[2]}\n" for r in rows)
    engine = Engine(spark, root)
    for name in ("pending.csv", "decided.csv"):
        (root / name).write_text(made)
        engine.guard(name)
    engine.apply("decided.csv", [{"column": "age", "action": "generalize"}])
    return engine.status()
