"""Column expressions: parsing, cleaning and null-safe arithmetic."""

from millrace.functions.columns import (  # noqa: F401
    add_suffix,
    clip,
    drop_nan,
    lookup_key,
    parse_date,
    parse_magnitude,
    parse_number,
    parse_rating,
    percent_label,
    ratio_change,
    yes_flag,
)
