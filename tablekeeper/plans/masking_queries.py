"""Masking queries and their SQL."""

from pyspark.sql import functions as F

from tablekeeper.functions import masking as fm
from tablekeeper.operators import masking as om
from tablekeeper.plans.fixtures import PEOPLE, SALT, load, people
from tablekeeper.plans.registry import query
from tablekeeper.session import work_dir

KEY = fm.salt_key(SALT)
_INNER, _OUTER = (pad.hex() for pad in fm.hmac_pads(KEY))


def _words(names):
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def digest_sql(x):
    return (
        f"sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}')"
        f" || encode(CAST({x} AS VARCHAR)))))"
    )


def number_sql(h, start, length):
    return f"CAST('0x' || substr({h}, {start}, {length}) AS BIGINT)"


def email_sql(h):
    return f"'user' || {number_sql(h, 1, 8)} || '@example.com'"


def name_sql(h):
    return (
        f"({_words(fm.FIRST_NAMES)})[{number_sql(h, 1, 4)} % 16 + 1] || ' ' || "
        f"({_words(fm.LAST_NAMES)})[{number_sql(h, 5, 4)} % 16 + 1]"
    )


def phone_sql(h):
    return f"'+1' || lpad(CAST({number_sql(h, 1, 12)} AS VARCHAR), 10, '0')"


def _one_column(name, column, expression_sql):
    sql = f"""WITH {PEOPLE}, d AS (SELECT c_custkey, {digest_sql(column)} AS h FROM people)
    SELECT c_custkey, {expression_sql('h')} AS masked FROM d"""
    strategy = {"mask_hash": "hash", "mask_email": "email", "mask_name": "name",
                "mask_phone": "phone"}[name]

    @query(name, sql)
    def run(spark, folder):
        mask = fm.STRATEGIES[strategy]
        return people(spark, folder).select("c_custkey", mask(F.col(column), KEY).alias("masked"))


_one_column("mask_hash", "email", lambda h: f"substr({h}, 1, 32)")
_one_column("mask_email", "email", email_sql)
_one_column("mask_name", "email", name_sql)
_one_column("mask_phone", "email", phone_sql)


@query("mask_digest", f"""WITH {PEOPLE}
SELECT c_custkey, {digest_sql('email')} AS email_digest, {digest_sql('c_custkey')} AS key_digest
FROM people""")
def mask_digest(spark, folder):
    return people(spark, folder).select(
        "c_custkey",
        fm.digest(F.col("email"), KEY).alias("email_digest"),
        fm.digest(F.col("c_custkey"), KEY).alias("key_digest"),
    )


@query("mask_fixed_values", f"""WITH {PEOPLE}
SELECT c_custkey, CASE WHEN email IS NOT NULL THEN '***' END AS redacted,
  CASE WHEN email IS NOT NULL THEN 'gone' END AS redacted_as,
  CASE WHEN email IS NOT NULL THEN 'anon' END AS constant_value,
  CAST(NULL AS VARCHAR) AS constant_unset, CAST(NULL AS INTEGER) AS nulled
FROM people""")
def mask_fixed_values(spark, folder):
    email = F.col("email")
    return people(spark, folder).select(
        "c_custkey",
        fm.as_redacted(email, KEY).alias("redacted"),
        fm.as_redacted(email, KEY, "gone").alias("redacted_as"),
        fm.as_constant(email, KEY, "anon").alias("constant_value"),
        fm.as_constant(email, KEY).alias("constant_unset"),
        fm.as_null(F.col("c_nationkey"), KEY).alias("nulled"),
    )


# The second rule on ``phone`` sees the first one's output.
RULES = [
    om.MaskRule("people", "email", "email"),
    om.MaskRule("people", "name", "name"),
    om.MaskRule("people", "phone", "phone"),
    om.MaskRule("people", "phone", "hash"),
    om.MaskRule("people", "c_mktsegment", "constant", "BUILDING"),
    om.MaskRule("people", "c_nationkey", "null"),
    om.MaskRule("people", "c_custkey", "hash"),
    om.MaskRule("orders", "o_custkey", "hash"),
]

MASKED_PEOPLE = f"""{PEOPLE},
h1 AS (SELECT *, {digest_sql('email')} AS he, {digest_sql('name')} AS hn, {digest_sql('phone')} AS hp
       FROM people),
h2 AS (SELECT *, {phone_sql('hp')} AS phone1 FROM h1),
masked_people AS (
  SELECT substr({digest_sql('c_custkey')}, 1, 32) AS c_custkey, {email_sql('he')} AS email,
    {name_sql('hn')} AS name, substr({digest_sql('phone1')}, 1, 32) AS phone,
    CASE WHEN c_mktsegment IS NOT NULL THEN 'BUILDING' END AS c_mktsegment,
    CAST(NULL AS INTEGER) AS c_nationkey
  FROM h2
)"""


@query("mask_table_rules", f"WITH {MASKED_PEOPLE} SELECT * FROM masked_people")
def mask_table_rules(spark, folder):
    return om.mask_table(people(spark, folder), "people", RULES, KEY)


_COUNTS_SQL = f"""{PEOPLE},
h1 AS (SELECT *, {digest_sql('email')} AS he, {digest_sql('name')} AS hn, {digest_sql('phone')} AS hp
       FROM people),
h2 AS (SELECT *, {phone_sql('hp')} AS phone1 FROM h1),
counts AS (
  SELECT 'people.email' AS masked_column,
    count(DISTINCT CASE WHEN {email_sql('he')} IS DISTINCT FROM email THEN email END) AS n_masked FROM h2
  UNION ALL SELECT 'people.name',
    count(DISTINCT CASE WHEN {name_sql('hn')} IS DISTINCT FROM name THEN name END) FROM h2
  UNION ALL SELECT 'people.phone', count(DISTINCT phone1) FROM h2
  UNION ALL SELECT 'people.c_mktsegment',
    count(DISTINCT CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END) FROM people
  UNION ALL SELECT 'people.c_nationkey', count(DISTINCT c_nationkey) FROM people
  UNION ALL SELECT 'people.c_custkey', count(DISTINCT c_custkey) FROM people
  UNION ALL SELECT 'orders.o_custkey', count(DISTINCT o_custkey) FROM orders
)"""


def _tables(spark, folder):
    return {"people": people(spark, folder), "orders": load(spark, folder, "orders")}


@query("mask_value_counts", f"WITH {_COUNTS_SQL} SELECT * FROM counts")
def mask_value_counts(spark, folder):
    return om.masked_counts(_tables(spark, folder), RULES, KEY)


@query("sanitize_counts", f"""WITH {_COUNTS_SQL} SELECT * FROM counts
UNION ALL SELECT 'total', CAST(sum(n_masked) AS BIGINT) FROM counts""")
def sanitize_counts(spark, folder):
    return om.with_total(
        om.sanitize(_tables(spark, folder), RULES, work_dir(spark, "sanitized"), SALT)
    )


@query("sanitize_copy", f"""WITH {PEOPLE}
SELECT o_orderkey, substr({digest_sql('o_custkey')}, 1, 32) AS o_custkey, o_orderstatus,
  o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority FROM orders""")
def sanitize_copy(spark, folder):
    out = work_dir(spark, "sanitized")
    om.sanitize(_tables(spark, folder), RULES, out, SALT)
    return spark.read.parquet(f"{out}/orders").withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


def _as_bigint(row):
    return row.select(*[F.col(c).cast("bigint").alias(c) for c in row.columns])


@query("mask_join_safety", f"""WITH {PEOPLE},
vals AS (SELECT CAST(c_custkey AS VARCHAR) AS v FROM people
  UNION SELECT CAST(o_custkey AS VARCHAR) FROM orders)
SELECT (SELECT count(*) FROM people JOIN orders ON c_custkey = o_custkey) AS raw_join_rows,
  (SELECT count(*) FROM (SELECT substr({digest_sql('c_custkey')}, 1, 32) AS m FROM people) a
   JOIN (SELECT substr({digest_sql('o_custkey')}, 1, 32) AS m FROM orders) b USING (m))
    AS masked_join_rows,
  (SELECT count(*) FROM (SELECT substr({digest_sql('v')}, 1, 32) AS m FROM vals GROUP BY m
   HAVING count(*) > 1)) AS merged_values""")
def mask_join_safety(spark, folder):
    tables = _tables(spark, folder)
    return _as_bigint(om.join_safety(
        tables["people"], "c_custkey", tables["orders"], "o_custkey", "hash", KEY
    ))


@query("mask_name_collisions", f"""WITH {PEOPLE},
vals AS (SELECT DISTINCT name AS v FROM people),
m AS (SELECT {name_sql('h')} AS m FROM (SELECT {digest_sql('v')} AS h FROM vals)),
masked AS (SELECT {name_sql('h')} AS m FROM (SELECT {digest_sql('name')} AS h FROM people))
SELECT (SELECT count(*) FROM people a JOIN people b USING (name)) AS raw_join_rows,
  (SELECT count(*) FROM masked a JOIN masked b USING (m)) AS masked_join_rows,
  (SELECT count(*) FROM (SELECT m FROM m GROUP BY m HAVING count(*) > 1)) AS merged_values""")
def mask_name_collisions(spark, folder):
    df = people(spark, folder)
    return _as_bigint(om.join_safety(df, "name", df, "name", "name", KEY))
