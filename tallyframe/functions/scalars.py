"""Scalar semantics that differ between engines, as Column expressions.

Everything here stays in whole-stage code: no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\x1c-\x1f\x85   -     　]+"
_TRIM = f"^{_SPACE}|{_SPACE}$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """Without white space of any kind at both ends (``trim`` takes off blanks only)."""
    return F.regexp_replace(col(c), _TRIM, "")


def rounded(c: Column | str, places: int = 2) -> Column:
    """Half to even on the exact binary value; infinities and NaN stay."""
    x = col(c)
    exact = F.regexp_replace(F.format_number(x, places), ",", "").try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(exact)


def safe_float(c: Column | str) -> Column:
    """A number if the text is one, else null; digit grouping by underscores counts, type suffixes don't."""
    x = trimmed(col(c).cast("string"))
    x = F.when(x.rlike(r"^[+-]?[0-9_.eE+-]+$") & ~x.rlike(r"(^|[^0-9])_|_([^0-9]|$)"), F.regexp_replace(x, "_", "")).otherwise(x)
    return F.when(x.rlike(r"[dDfF]$") & ~F.lower(x).rlike("^[+-]?inf$"), F.lit(None)).otherwise(x.try_cast("double"))


def without_fences(c: Column | str) -> Column:
    """A reply without the code fences that models put around JSON."""
    x = F.regexp_replace(trimmed(c), r"(?m)^```(?:json)?", "")
    return trimmed(F.regexp_replace(x, r"(?m)```$", ""))


def normalised(c: Column | str) -> Column:
    """Lower case; everything but a-z, 0-9 and single inner blanks gone."""
    x = F.regexp_replace(F.lower(col(c)), "[^a-z0-9 ]", " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def money(c: Column | str) -> Column:
    """Two places, with thousands separators."""
    return F.format_number(col(c), 2)


def signed_money(c: Column | str) -> Column:
    return F.concat(F.when(col(c) >= 0, F.lit("+")).otherwise(F.lit("")), money(c))


def exact(c: Column | str) -> Column:
    """Money as a decimal, so that sums don't depend on the order of rows."""
    return col(c).cast("decimal(18,2)")


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def contains_any(c: Column | str, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(col(c), F.lit(w))
    return out


def first_contained(c: Column | str, options: tuple[str, ...], default: str) -> Column:
    """The first option that the lower-cased text contains."""
    out = None
    for o in options:
        hit = F.contains(F.lower(col(c)), F.lit(o.lower()))
        out = F.when(hit, F.lit(o)) if out is None else out.when(hit, F.lit(o))
    return out.otherwise(F.lit(default))


def config_list(c: Column | str) -> Column:
    """Comma-separated values, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(col(c), ","), trimmed), lambda x: x != "")


def backoff_seconds(attempt: Column | str, most: int = 8) -> Column:
    return F.least(F.pow(F.lit(2.0), col(attempt)), F.lit(float(most)))


def upright(angle: Column | str) -> Column:
    """The small turn that rights a page found at an angle."""
    a = col(angle)
    return F.when(a < -45, 90 + a).when(a > 45, a - 90).otherwise(a)


def url_suffix(url: Column | str) -> Column:
    """Lower-case suffix of a URL's path, empty if none."""
    path = F.coalesce(F.try_parse_url(col(url), F.lit("PATH")), F.lit(""))
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))


def encoded(content: Column | str) -> Column:
    """Base64 in one line."""
    return F.replace(F.base64(col(content).cast("binary")), F.lit("\r\n"), F.lit(""))
