"""Timestamps of manifests and logs. Values without a zone are read as UTC."""

from pyspark.sql import functions as F

CLOCK_FORMAT = "HH:mm:ss yyyy-MM-dd"
ANY_CLOCK = "H:m:s y-M-d"
RUN_DIR_FORMAT = "yyyyMMdd'T'HHmmss"


def parse_timestamp(column):
    """Timestamp of an ISO text, also without signs, or of ``18:31:38 2026-03-15``, also with single digits;
    NULL when neither."""
    text = F.trim(column)
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]|$)"), text.try_cast("timestamp"))
    basic = F.regexp_replace(
        text, r"^(\d{4})(\d{2})(\d{2})(?:T(\d{2})(\d{2})(\d{2})?(.*))?$", "$1-$2-$3T$4:$5:$6$7")
    basic = F.regexp_replace(F.regexp_replace(basic, "T::$", ""), r":([Z+-].*)?$", "$1")
    basic = F.when(text.rlike(r"^\d{8}(T\d{4}(\d{2})?([.]\d+)?(Z|[+-].*)?)?$"), basic.try_cast("timestamp"))
    return F.coalesce(iso, basic, F.try_to_timestamp(text, F.lit(ANY_CLOCK)))


def format_clock(column):
    """``18:31:38 2026-03-15``, to the second."""
    return F.date_format(column, CLOCK_FORMAT)
