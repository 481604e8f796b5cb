"""Column-level cleaning. Everything here is a built-in expression, so it stays in generated code
and works the same on batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# A plain decimal number. Spark's own cast also accepts 'nan', 'inf' and '4.1d'.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# Text in front of the scale letter -> factor, tested in this order.
MAGNITUDES = (("K", 1e3), ("M", 1e6), ("B", 1e9))


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _to_double(c: Column) -> Column:
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))


def parse_rating(c: str | Column, suffix: str = "/5") -> Column:
    """``4.1/5`` -> 4.1; anything that is not a number -> NULL."""
    return _to_double(F.replace(_col(c), F.lit(suffix), F.lit("")))


def parse_number(c: str | Column) -> Column:
    """``1,200`` -> 1200.0; anything that is not a number -> NULL."""
    return _to_double(F.replace(_col(c), F.lit(","), F.lit("")))


def parse_magnitude(c: str | Column) -> Column:
    """``1.2K`` / ``3m`` / ``5B`` / ``17`` -> number; ``-``, NULL and junk -> NULL."""
    text = F.upper(F.trim(_col(c)))
    out = None
    for letter, factor in MAGNITUDES:
        value = _to_double(F.replace(text, F.lit(letter), F.lit(""))) * F.lit(factor)
        hit = text.contains(letter)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(_to_double(text))


def parse_date(c: str | Column, pattern: str = "d-M-yyyy") -> Column:
    """Text -> date under an explicit pattern; text that does not fit -> NULL."""
    return F.try_to_date(_col(c), pattern)


def yes_flag(c: str | Column, yes: str = "Yes") -> Column:
    """1 for exactly ``yes``, 0 for everything else including NULL."""
    return F.when(_col(c) == yes, 1).otherwise(0)


def drop_nan(c: str | Column) -> Column:
    """NaN -> NULL."""
    return F.nanvl(_col(c), F.lit(None).cast("double"))


def add_suffix(c: str | Column, suffix: str = ".NS") -> Column:
    """Append ``suffix`` unless the text already contains it."""
    c = _col(c)
    return F.when(c.contains(suffix), c).otherwise(F.concat(c, F.lit(suffix)))


def lookup_key(c: str | Column) -> Column:
    """Case- and edge-space-insensitive form used to look names up."""
    return F.regexp_replace(F.lower(_col(c)), r"(?U)^\s+|\s+$", "")


def clip(c: str | Column, lower=None, upper=None) -> Column:
    """Limit to [lower, upper] and keep NULL as NULL (``least``/``greatest`` skip NULLs)."""
    c = _col(c)
    out = c
    if lower is not None:
        out = F.greatest(out, F.lit(lower))
    if upper is not None:
        out = F.least(out, F.lit(upper))
    return F.when(c.isNotNull(), out)


def ratio_change(new: str | Column, old: str | Column) -> Column:
    """``new / old - 1``; NULL when either side is missing or ``old`` is zero."""
    return F.try_divide(_col(new), _col(old)) - F.lit(1.0)


def percent_label(c: str | Column, digits: int = 1) -> Column:
    """0.873 -> ``87.3%``."""
    return F.format_string(f"%.{digits}f%%", F.round(_col(c) * 100, digits))
