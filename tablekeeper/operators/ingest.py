"""Run reports on their way in: fill, check, authorise, store once."""

from pyspark.sql import functions as F
from pyspark.sql import types as T


REPORT_COLUMNS = [
    "server_id", "server_name", "run_id", "profile", "db_type", "backup_type", "status",
    "size_bytes", "duration_ms", "started_at", "finished_at", "error",
]
# Longest text each field may hold, and whether it must be present.
TEXT_LIMITS = [
    ("server_id", 200, True), ("server_name", 200, True), ("run_id", 200, True),
    ("profile", 200, True), ("db_type", 50, True), ("backup_type", 50, True),
    ("started_at", 100, False), ("finished_at", 100, False), ("error", 2000, False),
]
STATUSES = ["success", "failed"]
NUMBERS = ["size_bytes", "duration_ms"]


def _given(column):
    return F.nullif(column, F.lit(""))


def _whole(df, name):
    """Whole number of a value, NULL when it is not one; numbers lose their fraction."""
    column = F.col(name)
    if isinstance(df.schema[name].dataType, T.NumericType):
        return column.try_cast("bigint")
    text = F.trim(column)
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))


def normalise(df, default_server="localhost"):
    """Fill the defaults of raw reports; extra columns stay."""
    server = F.coalesce(_given(F.col("server_id")), F.lit(default_server))
    text = [F.coalesce(c, F.lit("None")) for c in (F.col("profile"), F.col("finished_at"))]
    made = {
        "server_id": server,
        "server_name": F.coalesce(_given(F.col("server_name")), server),
        "run_id": F.coalesce(_given(F.col("run_id")), F.concat_ws(":", server, *text)),
        "backup_type": F.coalesce(_given(F.col("backup_type")), F.lit("full")),
        "size_bytes": _whole(df, "size_bytes"),
        "duration_ms": _whole(df, "duration_ms"),
    }
    return df.select(*[
        made[name].alias(name) if name in made else F.col(name) for name in df.columns
    ])


def with_reasons(df):
    """Add ``reasons``: what is wrong with each report, empty when it is fine."""
    checks = []
    for name, longest, needed in TEXT_LIMITS:
        size = F.char_length(F.col(name))
        wrong = size > longest
        if needed:
            wrong = F.col(name).isNull() | (size < 1) | wrong
        checks.append(F.when(wrong, f"{name}: length"))
    status = F.col("status")
    checks.append(F.when(status.isNull() | ~status.isin(STATUSES), "status: value"))
    checks += [F.when(F.col(name) < 0, f"{name}: negative") for name in NUMBERS]
    return df.withColumn("reasons", F.sort_array(F.array_compact(F.array(*checks))))


def split_valid(df):
    """(valid reports, rejected reports with reasons)."""
    checked = with_reasons(df)
    valid = checked.filter(F.size("reasons") == 0).drop("reasons")
    return valid, checked.filter(F.size("reasons") > 0)


def client_ip(forwarded, real):
    """First forwarded-for entry, else the real address, else ``unknown``."""
    first = F.trim(F.get(F.split(forwarded, ","), F.lit(0)))
    return F.coalesce(_given(first), _given(real), F.lit("unknown"))


def authorise(df, tokens, shared_token=None):
    """Add ``token_id`` and ``authorised``. A revoked token counts as unknown."""
    known = (
        tokens.filter(F.col("revoked_at").isNull())
        .groupBy(F.col("token_hash").alias("_hash"))
        .agg(F.min("id").alias("token_id"))
    )
    token = _given(F.col("token"))
    hashed = df.withColumn("_hash", F.sha2(token, 256))
    joined = hashed.join(known, "_hash", "left").drop("_hash")
    allowed = F.col("token_id").isNotNull()
    if shared_token:
        allowed = allowed | F.coalesce(token == shared_token, F.lit(False))
    return joined.withColumn("authorised", allowed)


def _audit_entry():
    missing = _given(F.col("token")).isNull()
    return [
        F.col("seq").alias("id"),
        F.col("reported_at").alias("at"),
        F.lit("ingest.unauthorized").alias("event"),
        F.lit("agent").alias("actor"),
        client_ip(F.col("forwarded_for"), F.col("real_ip")).alias("ip"),
        F.when(missing, "missing token").otherwise("invalid token").alias("detail"),
    ]


def unauthorised_audit(df):
    """Audit rows of the reports ``authorise`` turned away."""
    return df.filter(~F.col("authorised")).select(*_audit_entry())


SENDER_COLUMNS = ("token", "forwarded_for", "real_ip")


def decide(df, tokens, shared_token=None):
    """Every raw report with its ``_part``, in one pass.

    ``accepted`` and ``rejected`` reports are filled and have their ``reasons``; of one turned away (``audit``) only its
    audit row is kept, as ``_audit``. What tells about the sender goes.
    """
    checked = authorise(df, tokens, shared_token)
    known = F.col("authorised")
    filled = with_reasons(normalise(checked.withColumn("_audit", F.when(~known, F.struct(*_audit_entry())))))
    part = F.when(~known, "audit").when(F.size("reasons") > 0, "rejected").otherwise("accepted")
    kept = [c for c in filled.columns if c not in ("authorised", "_audit", *SENDER_COLUMNS)]
    return filled.select(*[F.when(known, F.col(c)).alias(c) for c in kept], "_audit", part.alias("_part"))


def token_use(tokens, authorised):
    """Tokens with ``last_used_at`` moved to their newest accepted use."""
    used = (
        authorised.filter(F.col("token_id").isNotNull())
        .groupBy(F.col("token_id").alias("id")).agg(F.max("reported_at").alias("_used"))
    )
    return (
        tokens.join(used, "id", "left")
        .withColumn("last_used_at", F.greatest("last_used_at", "_used"))
        .select(*tokens.columns)
    )


def servers_of(reports):
    """One row per server: newest name, last and first time seen. Repeats count as seen."""
    newest = F.max(F.struct("reported_at", "seq", "server_name"))
    return reports.groupBy(F.col("server_id").alias("id")).agg(
        newest["server_name"].alias("name"),
        F.max("reported_at").alias("last_seen_at"),
        F.min("reported_at").alias("created_at"),
    )


def first_reports(reports):
    """The first report of each run id, over all servers."""
    rest = [c for c in reports.columns if c not in ("run_id", "reported_at", "seq")]
    first = F.min(F.struct("reported_at", "seq", *rest)).alias("first")
    return reports.groupBy("run_id").agg(first).select("run_id", "first.*").select(*reports.columns)


def clashing_run_ids(reports):
    """Run ids used by more than one server: all but the first server's runs are ignored."""
    return (
        reports.groupBy("run_id").agg(F.countDistinct("server_id").alias("n_servers"))
        .filter(F.col("n_servers") > 1)
    )
