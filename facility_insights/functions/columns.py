"""Reusable column expressions (no Python UDFs)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_tokens(c: str | Column, tokens: Iterable[str]) -> Column:
    """Exact-cell match of a missing token -> NULL, other values unchanged."""
    c = _c(c)
    return F.when(c.isin(list(tokens)), F.lit(None)).otherwise(c)


def clean_numeric_text(c: str | Column, strict: bool = False) -> Column:
    """Money / percent text -> double.

    Trim, remove ``%``, ``,`` and ``$``; a remainder made only of ``nan``/``NA``/``*`` pieces
    (or nothing) is missing; the rest is cast. ``strict`` raises on unparsable text like
    ``float`` does, otherwise such text becomes NULL.
    """
    stripped = F.regexp_replace(F.trim(_c(c)), r"[%,$]", "")
    missing = stripped.rlike(r"^(nan|NA|\*)*$")
    value = stripped.cast("double") if strict else stripped.try_cast("double")
    return F.when(_c(c).isNull() | missing, F.lit(None).cast("double")).otherwise(value)


def canonical_key(c: str | Column, via_float: bool = False) -> Column:
    """Entity key as text with exactly one leading '0' removed.

    ``via_float`` is for keys that went through a float: the fraction is cut off at '.', and no leading
    zero is left (a lone 0 stays).
    """
    k = _c(c).cast("string")
    if via_float:
        return F.regexp_replace(F.split_part(k, F.lit("."), F.lit(1)), r"^0+(.)", "$1")
    return F.regexp_replace(k, r"^0", "")


def parse_signed_coord(c: str | Column) -> Column:
    """'+32.5°' -> 32.5, '–86.6°' -> -86.6: first char is the sign (anything but '+' is
    negative), last char is a unit mark."""
    c = _c(c)
    magnitude = c.substr(F.lit(2), F.length(c) - 2).cast("double")
    sign = F.when(c.substr(1, 1) == "+", F.lit(1.0)).otherwise(F.lit(-1.0))
    return sign * magnitude


def days_since(c: str | Column, reference: str = S.OPERATION_REFERENCE_DATE, fmt: str = S.CERT_DATE_FORMAT) -> Column:
    """Whole days from a text date to the reference date (negative when later)."""
    return F.datediff(F.lit(reference).cast("date"), F.to_date(_c(c), fmt))


def text_key(*cols: str | Column, lower: bool = False) -> Column:
    """'a b' composite key; any null part gives a null key (no match)."""
    k = F.concat_ws(" ", *[_c(x) for x in cols])
    nulls = None
    for x in cols:
        nulls = _c(x).isNull() if nulls is None else (nulls | _c(x).isNull())
    k = F.when(nulls, F.lit(None).cast("string")).otherwise(k)
    return F.lower(k) if lower else k


def safe_div(a: str | Column, b: str | Column) -> Column:
    """x / 0 -> NULL (ANSI-safe)."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def haversine_miles(lat1: str | Column, lng1: str | Column, lat2: str | Column, lng2: str | Column) -> Column:
    """Great-circle distance in miles, ``2R asin(sqrt(least(1, h)))``."""
    r_miles = S.EARTH_RADIUS_KM * S.KM_TO_MILES
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dlat = p2 - p1
    dlng = F.radians(_c(lng2)) - F.radians(_c(lng1))
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlng / 2), 2)
    return F.lit(2 * r_miles) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def md5_rank_key(key: str | Column, seed: int | str) -> Column:
    """Deterministic pseudo-random order key, independent of partitioning."""
    return F.md5(F.concat(_c(key).cast("string"), F.lit(f"|{seed}")))


def md5_uniform(key: str | Column, seed: int | str) -> Column:
    """Uniform number in [0, 1) from the first 8 hex digits of md5(key|seed)."""
    h = F.substring(md5_rank_key(key, seed), 1, 8)
    return F.conv(h, 16, 10).cast("double") / F.lit(4294967296.0)


def round6(c: str | Column) -> Column:
    return F.round(_c(c).cast("double"), 6)
