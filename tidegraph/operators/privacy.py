"""Pseudonyms and redaction of sensitive fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegraph.functions.scalars import hmac_sha256

# fixed values
SENSITIVE = ("userName", "prodUserName", "prodUserID")
REDACTED = "<redacted>"


def prefix(field: str) -> str:
    """A field's name without a trailing Name or ID, in lower case, at most 8 characters."""
    low = field.lower()
    for end in ("name", "id"):
        if low.endswith(end) and len(low) > len(end):
            low = low[: -len(end)]
            break
    return low[:8]


def pseudonym(field: str, value: Column, salt: str) -> Column:
    """A stable token: the field's prefix and 8 digits of a keyed hash over field and value; null stays null."""
    return F.concat(F.lit(prefix(field) + "-"), F.substring(hmac_sha256(salt, F.concat(F.lit(field + ":"), value.cast("string"))), 1, 8))


def pseudonymise(record: Column, salt: str, fields: Sequence[str] = SENSITIVE) -> Column:
    """A map of fields with the sensitive ones replaced by pseudonyms."""

    def one(k: Column, v: Column) -> Column:
        out = v
        for f in fields:
            out = F.when(k == f, pseudonym(f, v, salt)).otherwise(out)
        return out

    return F.transform_values(record, one)


def redact(record: Column, fields: Sequence[str] = SENSITIVE) -> Column:
    """A map with sensitive fields redacted wherever their key is there, null or not."""
    return F.transform_values(record, lambda k, v: F.when(k.isin(*fields), F.lit(REDACTED)).otherwise(v))


def sensitive_fields(extra: Sequence[str] = (), setting: str | None = None) -> list[str]:
    """The default fields, more of them, and those of a comma-separated setting."""
    return sorted({*SENSITIVE, *extra, *(x.strip() for x in (setting or "").split(",") if x.strip())})
