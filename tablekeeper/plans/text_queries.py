"""Queries over texts, encrypted columns and throttled events."""

from pyspark.sql import functions as F

from tablekeeper.operators import crypto, redact, throttle
from tablekeeper.plans.fixtures import DAY_MS, SECRET_TEXTS, load, secret_texts
from tablekeeper.plans.registry import query

# Secrets known from a configuration.
SECRETS = ["on", "ention", "tion", "", "the"]

# The redaction patterns of functions/redaction.py in the form of DuckDB's regular expressions.
SQL_PATTERNS = [
    ("mongodb_uri", r"(mongodb(?:\+srv)?://[^:/@\s]+:)([^@/\s]+)(@)", r"\1***\3", "gi"),
    ("postgres_uri", r"(postgres(?:ql)?://[^:/@\s]+:)([^@/\s]+)(@)", r"\1***\3", "gi"),
    ("mysql_uri", r"(mysql://[^:/@\s]+:)([^@/\s]+)(@)", r"\1***\3", "gi"),
    ("password_option", r"(--password(?:=|\s+))(\S+)", r"\1***", "g"),
    ("password_field", r"(password=)([^&\s]+)", r"\1***", "gi"),
]


def _steps_sql(text):
    for _, pattern, replacement, flags in SQL_PATTERNS:
        text = f"regexp_replace({text}, '{pattern}', '{replacement}', '{flags}')"
    return text


@query("redact_texts", f"WITH {SECRET_TEXTS} SELECT doc_id, {_steps_sql('text')} AS text FROM secret_texts")
def redact_texts(spark, folder):
    return redact.redact_text(secret_texts(spark, folder), "text").select("doc_id", "text")


@query("redact_known_secrets", f"""WITH {SECRET_TEXTS}
SELECT doc_id, replace(replace(replace(replace({_steps_sql('text')}, 'ention', '***'),
  'tion', '***'), 'the', '***'), 'on', '***') AS text FROM secret_texts""")
def redact_known_secrets(spark, folder):
    return redact.redact_text(secret_texts(spark, folder), "text", SECRETS).select("doc_id", "text")


def _count_sql(name):
    text = "text"
    for key, pattern, replacement, flags in SQL_PATTERNS:
        if key == name:
            case = "(?i)" if "i" in flags else ""
            return f"CAST(sum(len(regexp_extract_all({text}, '{case}{pattern}'))) AS BIGINT) AS {name}"
        text = f"regexp_replace({text}, '{pattern}', '{replacement}', '{flags}')"


@query("redaction_report", f"""WITH {SECRET_TEXTS}
SELECT source, count(*) AS n_rows, count(*) FILTER ({_steps_sql('text')} <> text) AS n_changed,
  {', '.join(_count_sql(p[0]) for p in SQL_PATTERNS)}
FROM secret_texts GROUP BY source""")
def redaction_report(spark, folder):
    return redact.redaction_report(secret_texts(spark, folder), "text", ["source"])


# --- encryption ----------------------------------------------------------------------------------

PASSPHRASE = "a passphrase for tests"


def _sealed(spark, folder):
    texts = load(spark, folder, "documents").select(
        "doc_id", "lang", F.encode("text", "UTF-8").alias("data"), F.octet_length("text").alias("n")
    )
    return crypto.encrypt(texts, "data", PASSPHRASE)


@query("encrypt_round_trip", """SELECT doc_id, sha256(text) AS digest, CAST(49 AS BIGINT) AS overhead
FROM documents""")
def encrypt_round_trip(spark, folder):
    sealed = _sealed(spark, folder).withColumn("overhead", F.octet_length("data") - F.col("n"))
    opened = crypto.decrypt(sealed, "data", PASSPHRASE)
    return opened.filter(F.col("reason").isNull()).select(
        "doc_id", F.sha2("data", 256).alias("digest"), F.col("overhead").cast("bigint")
    )


@query("encrypt_bucket_keys", """SELECT doc_id, lang, sha256(text) AS digest, CAST(57 AS BIGINT) AS overhead,
  CAST(NULL AS VARCHAR) AS reason FROM documents
UNION ALL SELECT doc_id, 'changed', NULL, CAST(57 AS BIGINT), 'wrong passphrase or corrupt' FROM documents""")
def encrypt_bucket_keys(spark, folder):
    """Texts under bucket keys opened again, and refused with the number of another bucket."""
    texts = load(spark, folder, "documents").select(
        "doc_id", "lang", F.encode("text", "UTF-8").alias("data"), F.octet_length("text").alias("n"))
    sealed = crypto.encrypt_in_buckets(texts, "data", PASSPHRASE).withColumn(
        "overhead", (F.octet_length("data") - F.col("n")).cast("bigint"))
    moved = F.concat(F.substring("data", 1, 28), F.lit(b"\x01"), F.substring("data", 30, 2**31 - 1))
    both = sealed.unionByName(sealed.withColumn("lang", F.lit("changed")).withColumn("data", moved))
    return crypto.decrypt(both.drop("n"), "data", PASSPHRASE).select(
        "doc_id", "lang", F.sha2("data", 256).alias("digest"), "overhead", "reason")


@query("encrypt_rejections", """SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 THEN 'too small or corrupt'
  WHEN doc_id % 5 = 1 THEN 'bad magic' WHEN doc_id % 5 = 2 THEN 'unsupported version'
  WHEN doc_id % 5 = 3 THEN 'wrong passphrase or corrupt' END AS reason FROM documents""")
def encrypt_rejections(spark, folder):
    kind, data = F.col("doc_id") % 5, F.col("data")
    rest = F.substring(data, 6, 2**31 - 1)
    damaged = (
        F.when(kind == 0, F.substring(data, 1, 40))
        .when(kind == 1, F.concat(F.lit(b"NOPE\x01"), rest))
        .when(kind == 2, F.concat(F.lit(crypto.MAGIC + b"\x07"), rest))
        .when(kind == 3, F.concat(data, F.lit(b"\x00")))
        .otherwise(data)
    )
    sealed = _sealed(spark, folder).withColumn("data", damaged)
    return crypto.decrypt(sealed, "data", PASSPHRASE).select("doc_id", "lang", "reason")


@query("encrypt_detect", """SELECT doc_id, true AS sealed, false AS plain FROM documents""")
def encrypt_detect(spark, folder):
    texts = load(spark, folder, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    return _sealed(spark, folder).join(texts, "doc_id").select(
        "doc_id", crypto.is_encrypted(F.col("data")).alias("sealed"),
        crypto.is_encrypted(F.col("raw")).alias("plain"),
    )


# --- throttle ------------------------------------------------------------------------------------

def throttle_events(spark, folder):
    return load(spark, folder, "events").select(
        F.col("user_id").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"),
        F.col("event_id").alias("id"),
    )


def throttle_sql(window, limit):
    """The definition event by event: a recursive walk over each key's ordered events."""
    return f"""WITH RECURSIVE e AS (
  SELECT user_id AS key, epoch_us(ts) // 1000 AS at_ms, event_id AS id,
    row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n
  FROM events
),
walk AS (
  SELECT key, at_ms, id, n, at_ms + {window} AS reset, 1 AS used, true AS allowed FROM e WHERE n = 1
  UNION ALL
  SELECT e.key, e.at_ms, e.id, e.n,
    CASE WHEN e.at_ms > w.reset THEN e.at_ms + {window} ELSE w.reset END,
    CASE WHEN e.at_ms > w.reset THEN 1 WHEN w.used >= {limit} THEN w.used ELSE w.used + 1 END,
    e.at_ms > w.reset OR w.used < {limit}
  FROM walk w JOIN e ON e.key = w.key AND e.n = w.n + 1
)
SELECT key, at_ms AS "at", id, allowed FROM walk"""


@query("throttle_events", throttle_sql(DAY_MS, 2))
def throttle_daily(spark, folder):
    return throttle.throttle(throttle_events(spark, folder), DAY_MS, 2)


@query("throttle_default", throttle_sql(throttle.WINDOW_MS, throttle.LIMIT))
def throttle_default(spark, folder):
    return throttle.throttle(throttle_events(spark, folder))
