"""Column expressions. All are built-in Spark functions, so they stay inside whole-stage codegen."""

from .columns import (  # noqa: F401
    canonical_key,
    clean_numeric_text,
    days_since,
    haversine_miles,
    md5_rank_key,
    md5_uniform,
    null_tokens,
    parse_signed_coord,
    round6,
    safe_div,
    text_key,
)
