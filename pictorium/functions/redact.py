"""Secret, path and URL redaction with chained ``regexp_replace``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V

_K, _E = V.SECRET_CHARS, V.ENCRYPTED_CHARS
# 11..64 characters keep four at each end; 8..10 vanish.  A group that took no
# part in the match expands to nothing, so one replacement serves both cases.
SECRET = rf"(?i)({V.SECRET_PREFIX})(?:({_K}{{4}}){_K}{{3,56}}({_K}{{4}})|{_K}{{8,10}})"
ENCRYPTED = rf"(?i)({V.ENCRYPTED_PREFIX})({_E}{{4}}){_E}{{8,}}({_E}{{4}})"


def mask_value(value: Column) -> Column:
    short = F.octet_length(value) <= 10
    ends = F.concat(F.substring(value, 1, 4), F.lit("****"), F.right(value, F.lit(4)))
    return F.when(value == "", F.lit("")).when(short, F.lit("****")).otherwise(ends)


def redact_path(path: Column) -> Column:
    hit = path.rlike(V.WINDOWS_PATH) | path.rlike(V.UNIX_PATH)
    return F.when(hit, F.lit("[REDACTED_PATH]")).otherwise(path)


def redact_url(url: Column) -> Column:
    return F.regexp_replace(url, V.URL_SECRET, "$1=[REDACTED]")


def sanitize_log(text: Column) -> Column:
    """Mask keys, encrypted values, file paths and URL secrets in log text."""
    out = F.regexp_replace(text, SECRET, "$1$2****$3")
    out = F.regexp_replace(out, ENCRYPTED, "$1$2****$3")
    out = F.regexp_replace(out, V.WINDOWS_PATH, "[REDACTED_PATH]")
    out = F.regexp_replace(out, V.UNIX_PATH, "[REDACTED_PATH]")
    return redact_url(out)


def sanitize_error(text: Column) -> Column:
    out = F.regexp_replace(text, V.ERROR_PATH, "[PATH]")
    return F.regexp_replace(out, V.ERROR_SQL, "[QUERY]")
