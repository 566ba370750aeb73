"""Column functions: identifiers, keyed hashes, text and number formats. All run inside the JVM."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: name spaces of version-5 UUIDs
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"
NAMESPACE_OID = "6ba7b8129dad11d180b400c04fd430c8"
# fixed value: targets of links in error texts and pages
HREF = r"""(?i)<a\s+[^>]*href=["']([^"']+)["'][^>]*>"""


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    """Version-5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    digit = F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4
    variant = F.element_at(F.array(*map(F.lit, "89ab")), digit + 1)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def hmac_sha256(key: str, message: Column) -> Column:
    """Hex HMAC-SHA256 of a message, from nested hashes."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in raw) for pad in (0x36, 0x5C))
    first = F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


def safe_filename(name: Column) -> Column:
    """Runs of characters other than letters, digits, dot, underscore and dash become one underscore; none at the ends."""
    return F.trim(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), F.lit("_"))


def token_estimate(text: Column) -> Column:
    """About a token for three characters."""
    return F.floor((F.length(text) + 2) / 3).cast("int")


def gist(text: Column, limit: int = 200) -> Column:
    """White space collapsed, cut to the limit with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))).otherwise(flat)


def hrefs(html: Column) -> Column:
    """Targets of all anchors, in order."""
    return F.regexp_extract_all(html, F.lit(HREF), 1)


def code_hash(code: Column) -> Column:
    """SHA-256 of code without trailing white space and blank lines."""
    lines = F.filter(F.transform(F.split(code, "\n"), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: x != "")
    return F.sha2(F.array_join(lines, "\n"), 256)


def parse_time(text: Column) -> Column:
    """ISO times with T or a space, or the older day-first form; null if neither."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "dd-MMM-yy HH:mm:ss")))


def duration(seconds: Column) -> Column:
    """45s, 3m2s or 1h2m; null for null and negative."""
    s = seconds.cast("long")
    whole = lambda x: F.floor(x).cast("long").cast("string")
    minutes = F.concat(whole(s / 60), F.lit("m"), whole(s % 60), F.lit("s"))
    hours = F.concat(whole(s / 3600), F.lit("h"), whole(s % 3600 / 60), F.lit("m"))
    return F.when(s < 0, F.lit(None).cast("string")).when(s < 60, F.concat(whole(s), F.lit("s"))).when(s < 3600, minutes).when(s >= 3600, hours)


def offset(seconds: Column) -> Column:
    """3m02s or 1h05m."""
    s = seconds.cast("int")
    return F.when(s < 3600, F.format_string("%dm%02ds", F.floor(s / 60).cast("int"), s % 60)).otherwise(F.format_string("%dh%02dm", F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int")))


def gib(size: Column) -> Column:
    return F.format_string("%.1f GiB", size / (1 << 30))


def procedure_name(tools: Column) -> Column:
    """proc__a__b of sorted tools; over 60 characters the first 51, an underscore and 8 digits of the hash."""
    name = F.concat(F.lit("proc__"), F.array_join(F.array_sort(F.array_distinct(tools)), "__"))
    return F.when(F.length(name) > 60, F.concat(F.substring(name, 1, 51), F.lit("_"), F.substring(F.sha2(name, 256), 1, 8))).otherwise(name)


def references(code: str | None) -> list[str] | None:
    """Names used as `tools.<name>` in code, sorted; null where it can't be parsed."""
    try:
        tree = ast.parse(code or "")
    except (SyntaxError, ValueError):
        return None
    return sorted({n.attr for n in ast.walk(tree) if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id == "tools"})


def tool_references(code: Column) -> Column:
    """Names that code uses of `tools`, called or not, sorted, by its syntax tree; null where it can't be parsed."""
    return F.pandas_udf(lambda c: c.map(references), "array<string>")(code)


def same_model(a: Column, b: Column) -> Column:
    """Model names are equal, or equal before their tag."""
    return (a == b) | (F.split_part(a, F.lit(":"), F.lit(1)) == F.split_part(b, F.lit(":"), F.lit(1)))


def cosine(a: Column, b: Column, epsilon: float = 0.0) -> Column:
    """Cosine of two arrays of numbers in double precision; null where a norm is zero and no epsilon is given."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + epsilon
    return dot(a, b) / F.nullif(norms, F.lit(0.0))


def config_namespace(config: str, provider: str) -> str:
    """A short id of a tool configuration and a provider."""
    return hashlib.sha1(f"{config}|{provider}".encode()).hexdigest()[:16]


def confidence_band(confidence: Column) -> Column:
    """high from 0.7, medium from 0.4, else low."""
    return F.when(confidence >= 0.7, "high").when(confidence >= 0.4, "medium").otherwise("low")


def expanded(text: str, variables: Mapping[str, str]) -> str:
    """text with each ${NAME} replaced by the variable of that name; names that aren't there stay as they are."""
    return re.sub(r"\$\{([^}]+)\}", lambda m: variables.get(m[1], m[0]), text)


def quoted(value: Column) -> Column:
    """A text between single quotes, None for null."""
    return F.coalesce(F.concat(F.lit("'"), value.cast("string"), F.lit("'")), F.lit("None"))
