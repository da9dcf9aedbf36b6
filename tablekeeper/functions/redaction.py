"""Secrets in text, replaced by ``***``."""

import itertools

from pyspark.sql import functions as F

REDACTED = "***"
#: So many secrets become a chain of compiled replacements; more would make too deep an expression.
CHAINED = 64

# Fixed values: (name, text every match contains, pattern, replacement), applied in this order.
# Blanks are Unicode blanks.
_BLANK = r"\s\x1c-\x1f"
PATTERNS = [
    ("mongodb_uri", "://",
     rf"(?iU)(mongodb(?:\+srv)?://[^:/@{_BLANK}]+:)([^@/{_BLANK}]+)(@)", "$1***$3"),
    ("postgres_uri", "://",
     rf"(?iU)(postgres(?:ql)?://[^:/@{_BLANK}]+:)([^@/{_BLANK}]+)(@)", "$1***$3"),
    ("mysql_uri", "://", rf"(?iU)(mysql://[^:/@{_BLANK}]+:)([^@/{_BLANK}]+)(@)", "$1***$3"),
    ("password_option", "--password",
     rf"(?U)(--password(?:=|[{_BLANK}]+))([^{_BLANK}]+)", "$1***"),
    ("password_field", "=", rf"(?iU)(password=)([^&{_BLANK}]+)", "$1***"),
]


def redact_patterns(text):
    """Texts without the contained text skip its patterns; redaction never brings it in."""
    original = text
    for contained, group in itertools.groupby(PATTERNS, key=lambda p: p[1]):
        changed = text
        for _, _, pattern, replacement in group:
            changed = F.regexp_replace(changed, pattern, replacement)
        text = F.when(original.contains(contained), changed).otherwise(text)
    return text


def redact_secrets(text, secrets):
    """Replace known secrets, longest first; empty ones are ignored."""
    known = sorted({s for s in secrets if s}, key=lambda s: (-len(s), s))
    if not known:
        return text
    if len(known) > CHAINED:
        words = F.array(*[F.lit(s) for s in known])
        return F.aggregate(words, text, lambda done, s: F.replace(done, s, F.lit(REDACTED)))
    for secret in known:
        text = F.replace(text, F.lit(secret), F.lit(REDACTED))
    return text


def redact(text, secrets=()):
    return redact_secrets(redact_patterns(text), secrets)
