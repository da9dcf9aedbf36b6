"""Audit log: append and recent entries."""

import logging

from pyspark.sql import functions as F

COLUMNS = ["id", "at", "event", "actor", "ip", "detail"]


def append_audit(rows, path):
    """Append audit rows. A failing log never breaks the work it records."""
    try:
        rows.select(*COLUMNS).write.mode("append").parquet(path)
        return True
    except Exception:
        logging.getLogger(__name__).exception("audit rows could not be written")
        return False


def recent_audit(audit, limit=100):
    """Newest entries first."""
    return audit.orderBy(F.desc("at"), F.desc("id")).limit(limit)
